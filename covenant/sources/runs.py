"""Run records (SNK-1): one statement run over one data table, one record.

The record's row and null counts are metrics observed by the very job that
writes the full result (``DataFrame.observe``); statistics, sanity checks and
the sample are then read from the written result. Records and results are
partitioned by run, so a retried run replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant import terms
from covenant.operators import execution as ex
from covenant.operators import profile as pf
from covenant.operators import quality as dq
from covenant.sources.sinks import append_ledger, json_rows

STATISTIC = T.StructType([T.StructField("column_name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("stat", T.StringType()),
                          T.StructField("value", T.DoubleType()), T.StructField("text", T.StringType())])
CHECK = T.StructType([T.StructField("column_name", T.StringType()), T.StructField("check", T.StringType()), T.StructField("severity", T.StringType()),
                      T.StructField("value", T.DoubleType()), T.StructField("detail", T.StringType())])
RECORD = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("query_id", T.StringType()), T.StructField("execution_status", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("query_text", T.StringType()),
    T.StructField("table_name", T.StringType()), T.StructField("source_file", T.StringType()),
    T.StructField("rows_count", T.LongType()), T.StructField("columns", T.ArrayType(T.StringType())), T.StructField("column_types", T.ArrayType(T.StringType())),
    T.StructField("null_counts", T.ArrayType(T.LongType())),
    T.StructField("sample_data", T.ArrayType(T.StringType())), T.StructField("sample_truncated", T.BooleanType()), T.StructField("sample_limit", T.IntegerType()),
    T.StructField("sanity_check_status", T.StringType()), T.StructField("sanity_checks", T.ArrayType(CHECK)),
    T.StructField("statistics", T.ArrayType(STATISTIC)),
    T.StructField("input_rows", T.LongType()), T.StructField("input_columns", T.IntegerType()),
    T.StructField("output_rows", T.LongType()), T.StructField("output_columns", T.IntegerType())])


def observed_write(result: DataFrame, path: str, run_id: str, observation: Observation) -> DataFrame:
    """Writes ``result`` under its run and returns the written rows; ``observation`` gets their number and the null cells of each column."""
    nulls = [F.count_if(F.col(pf.quoted(c)).isNull()).alias(f"nulls_{i}") for i, c in enumerate(result.columns)]
    seen = result.observe(observation, F.count(F.lit(1)).alias("rows"), *nulls)
    # the run's own folder: only its schema, only its files
    folder = f"{path.rstrip('/')}/run_id={run_id}"
    seen.write.mode("overwrite").parquet(folder)
    return result.sparkSession.read.schema(result.schema).parquet(folder)


def run_record(spark: SparkSession, sql: str, data: DataFrame, table_name: str, *, run_id: str, results: str, ledger: str,
               query_id: str | None = None, source_file: str | None = None, order: Sequence[str] = (),
               sample_limit: int = terms.RESULT_SAMPLE_LIMIT) -> DataFrame:
    """Runs one statement over ``data``, keeps the whole result and appends one run record; returns the record.

    A statement that is refused or fails leaves a record with status ``error``
    and its message. The sample is the first ``sample_limit`` rows by ``order``
    (any rows without one) as JSON. ``run_id`` names a folder: word characters,
    dots and dashes only.
    """
    if not run_id.replace("-", "").replace(".", "").replace("_", "").isalnum():
        raise ValueError(f"not a run id: {run_id!r}")
    head = {"run_id": run_id, "query_id": query_id, "query_text": sql, "table_name": table_name, "source_file": source_file,
            "input_columns": len(data.columns), "sample_limit": sample_limit}
    try:
        record = head | _executed(spark, sql, data, table_name, run_id, results, order, sample_limit)
    except (ValueError, PySparkException) as e:
        record = head | {"execution_status": "error", "message": f"{type(e).__name__}: {str(e).splitlines()[0]}"}
    row = spark.createDataFrame([tuple(record.get(f) for f in RECORD.fieldNames())], RECORD)
    append_ledger(row.withColumn("_run", F.col("run_id")), ledger, ["_run"])
    return read_records(spark, ledger).where(F.col("run_id") == run_id)


def _executed(spark: SparkSession, sql: str, data: DataFrame, table_name: str, run_id: str, results: str, order: Sequence[str], sample_limit: int) -> dict:
    wrote = Observation()
    result = ex.run_sql(spark, sql, {table_name: data})
    kept = observed_write(result, results, run_id, wrote)
    rows, nulls = wrote.get["rows"], [wrote.get[f"nulls_{i}"] for i in range(len(result.columns))]
    checks = [tuple(r) for r in dq.dq_report(kept).collect()]                   # some per column
    stats = [tuple(r) for r in pf.column_statistics(kept).collect()]            # some per column
    first = kept.orderBy(*[F.col(pf.quoted(c)).asc_nulls_last() for c in order]) if order else kept
    sample = [r["json"] for r in json_rows(first.limit(sample_limit)).collect()]
    return {"execution_status": "success", "message": f"Query executed successfully against {table_name}", "rows_count": rows,
            "columns": result.columns, "column_types": [t for _, t in result.dtypes], "sample_data": sample, "sample_truncated": rows > sample_limit,
            "sanity_check_status": "warning" if any(c[2] == "warning" for c in checks) else "passed", "sanity_checks": checks, "statistics": stats,
            "null_counts": nulls, "input_rows": data.count(), "output_rows": rows, "output_columns": len(result.columns)}


def read_records(spark: SparkSession, ledger: str) -> DataFrame:
    """All run records of a ledger."""
    return spark.read.schema(RECORD).parquet(ledger)
