"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import stage_table, temporary_tables


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, or edges up only (edges are distinct)."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down > 0 and up > 0").isEmpty()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the least node id reachable; nodes without an edge are absent.

    Every step aggregates and joins on one end of the edges, and writes the new
    edges as a table, so the number of links held anywhere is that of a task.
    The steps end when all components are stars around their least nodes.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    with temporary_tables(edges.sparkSession):
        e = stage_table(e, "edges")
        while not _stars(e):
            both = e.union(e.select("v", "u"))
            least = both.groupBy("u").agg(F.min("v").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            linked = large.join(least, "u")
            small = linked.select("u", F.col("m").alias("v")).union(linked.where("v <> m").select(F.col("v"), F.col("m"))).distinct()
            e = stage_table(small, "edges")
        ends = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v")).distinct()
        return stage_table(ends, "components", keep=True)
