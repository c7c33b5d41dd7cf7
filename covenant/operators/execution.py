"""Run a user statement over registered tables (PRJ-1/3, LIM-1..3, AGG-6)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covenant import terms

_LEADING = re.compile(r"^\s*(?:--[^\n]*\n\s*|/\*.*?\*/\s*)*(select|with)\b", re.IGNORECASE | re.DOTALL)


def default_query(table_name: str) -> str:
    """TXT-8/PRJ-3: the statement used when a response carries no SQL."""
    return f"SELECT * FROM {table_name}"


def run_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Run one read-only statement over ``tables`` and nothing else; at most ``limit`` rows.

    The statement is first analysed as a subquery in a session of its own, in
    which empty tables of the given names and schemas are all there is: DDL, DML
    (also behind a WITH), several statements, other tables and views, and files
    named as tables are refused before anything runs. It is then bound to the
    given frames under private view names; the caller's session keeps its own
    views of any name, and its settings.
    """
    body = (sql or "").strip().rstrip(";")
    if not _LEADING.match(body):
        raise ValueError("only a single SELECT/WITH query is accepted")
    apart = spark.newSession()
    apart.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in tables.items():
        apart.createDataFrame([], df.schema).createOrReplaceTempView(name)
    try:
        if apart.sql(f"SELECT * FROM (\n{body}\n)").inputFiles():
            raise ValueError("only the given tables can be read")
    except ParseException as e:
        raise ValueError("only a single SELECT/WITH query is accepted") from e
    private = {name: f"_given_{uuid.uuid4().hex}" for name in tables}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(private[name])
        given = ", ".join(f"`{n}` AS (SELECT * FROM {view})" for n, view in private.items())
        out = spark.sql(f"{'WITH ' + given if given else ''} SELECT * FROM (\n{body}\n)")
    finally:
        for view in private.values():
            spark.catalog.dropTempView(view)
    return out if limit is None else out.limit(limit)


def bounded_sample(df: DataFrame, order: Sequence[str], n: int = terms.RESULT_SAMPLE_LIMIT) -> DataFrame:
    """LIM-1: first ``n`` rows in a total order plus a ``truncated`` flag.

    Only ``n + 1`` rows ever leave the top-k operator, so the flag needs no
    second pass over the result: a (n+1)-th row exists iff truncated.
    """
    head = df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n + 1)
    w = Window.orderBy(*[F.col(c).asc_nulls_last() for c in order])   # ≤ n+1 rows
    ranked = head.withColumn("_rn", F.row_number().over(w))
    flagged = ranked.withColumn("truncated", F.max("_rn").over(Window.partitionBy()) > n)
    return flagged.filter(F.col("_rn") <= n).drop("_rn")


def page(df: DataFrame, order: Sequence[str], limit: int = 50, offset: int = 0) -> DataFrame:
    """LIM-3: stable paging on a total order."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).offset(offset).limit(limit)


def shape(input_df: DataFrame, result_df: DataFrame) -> DataFrame:
    """AGG-6: input/output rows and columns as one row.

    Both counts come from one job over a union of two narrow projections
    (no join), each side contributing a partial count per task.
    """
    u = (input_df.select(F.lit(1).alias("_i"), F.lit(0).alias("_o"))
         .unionByName(result_df.select(F.lit(0).alias("_i"), F.lit(1).alias("_o"))))
    return u.agg(
        F.coalesce(F.sum("_i"), F.lit(0)).cast("bigint").alias("input_rows"),
        F.lit(len(input_df.columns)).cast("bigint").alias("input_columns"),
        F.coalesce(F.sum("_o"), F.lit(0)).cast("bigint").alias("output_rows"),
        F.lit(len(result_df.columns)).cast("bigint").alias("output_columns"),
    )
