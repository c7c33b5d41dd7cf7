"""Exact medians without gathering a column into one task.

A quantile sketch of the first scan brackets the middle of each column; the
second scan counts the values inside the bracket and everything below it as one
number. The bracket reaches ``MARGIN`` of all rows to either side, many times
the sketch's error, so it holds the middle ranks; if it did not, the query
fails instead of giving a wrong median. Inside, values are dealt into chunks by
linear cuts (monotone in the value, so any cuts give exact results) and only
the chunks that hold a middle rank are ranked. Infinities are ordinary values.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNKS = 256
SKETCH_ACCURACY = 10_000
MARGIN = 0.005

Brackets = Mapping[str, tuple[float, float, int]]


def middle_bracket(x: Column) -> Column:
    """Aggregate: [low end, sketched median, high end] of the middle; null without values."""
    return F.percentile_approx(x, [0.5 - MARGIN, 0.5, 0.5 + MARGIN], SKETCH_ACCURACY)


def cells(df: DataFrame, numbers: Mapping[str, Column], brackets: Brackets, keys: Mapping[str, Column] | None = None) -> DataFrame:
    """(column_name, v, k, cnt) from one scan.

    ``numbers`` give a row per value inside their bracket and one with a null ``v``
    for all below it; ``keys`` a row per non-null key ``k``.
    """
    none_v, none_k = F.lit(None).cast("double"), F.lit(None).cast("string")
    cell = lambda name, v, k: F.struct(F.lit(name).alias("column_name"), v.alias("v"), k.alias("k"))
    items = [F.when(x <= F.lit(brackets[c][1]), cell(c, F.when(x >= F.lit(brackets[c][0]), x), none_k)) for c, x in numbers.items() if c in brackets]
    items += [F.when(k.isNotNull(), cell(c, none_v, k)) for c, k in (keys or {}).items()]
    long = df.select(F.explode(F.array(*items)).alias("_c")).where("_c is not null").select("_c.column_name", "_c.v", "_c.k")
    return long.groupBy("column_name", "v", "k").agg(F.count(F.lit(1)).alias("cnt"))


def medians(grouped: DataFrame, brackets: Brackets, chunks: int = CHUNKS) -> DataFrame:
    """(column_name, _median): the mean of the two middle values of each bracketed column.

    ``grouped`` comes from ``cells``.
    """
    spark = grouped.sparkSession
    known = spark.createDataFrame([(c, float(lo), float(hi), (n - 1) // 2, n // 2) for c, (lo, hi, n) in brackets.items()],
                                  "column_name string, _lo double, _hi double, _k0 long, _k1 long")
    # one row per column: a proven-small broadcast side
    dealt = grouped.where("k is null").join(F.broadcast(known), "column_name")
    dealt = dealt.withColumn("_chunk", F.when(F.col("v").isNotNull(), F.coalesce(F.width_bucket("v", "_lo", "_hi", F.lit(chunks)), F.lit(0))).otherwise(-1))
    totals = dealt.groupBy("column_name", "_chunk").agg(F.sum("cnt").alias("_total"))
    before = Window.partitionBy("column_name").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)    # at most chunks + 3 rows
    totals = totals.select("column_name", "_chunk", "_total", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_off")).join(F.broadcast(known), "column_name")
    holds = lambda k: (F.col(k) >= F.col("_off")) & (F.col(k) < F.col("_off") + F.col("_total"))
    wanted = totals.where((F.col("_chunk") >= 0) & (holds("_k0") | holds("_k1"))).select("column_name", "_chunk", "_off")
    inside = dealt.join(F.broadcast(wanted), ["column_name", "_chunk"])
    upto = F.col("_off") + F.sum("cnt").over(Window.partitionBy("column_name", "_chunk").orderBy("v"))
    at = lambda k: F.max(F.when((F.col(k) < F.col("_upto")) & (F.col(k) >= F.col("_upto") - F.col("cnt")), F.col("v")))
    found = inside.withColumn("_upto", upto).groupBy("column_name").agg(at("_k0").alias("_a"), at("_k1").alias("_b"))
    missed = F.raise_error(F.concat(F.lit("the middle of a column lies outside its bracket: "), F.col("column_name"))).cast("double")
    return F.broadcast(known).join(found, "column_name", "left").select(
        "column_name", F.when(F.col("_a").isNull() | F.col("_b").isNull(), missed).otherwise((F.col("_a") + F.col("_b")) / 2.0).alias("_median"))
