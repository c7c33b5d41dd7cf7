"""Sinks (SNK-1, SNK-2, SNK-4): ledgers, full results, JSON rows.

Everything is written under the shared checkpoint folder of the cluster
(``spark.checkpoint.dir``) or a caller-given shared path — never a
machine-local temporary folder — and is re-read from there, which also
cuts the lineage of what was written.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/covenant-{name}-{uuid.uuid4().hex[:12]}"


def append_ledger(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """SNK-1: append run records. Partitioned by run, a retry replaces the
    partitions it writes instead of doubling their rows; other runs stay."""
    if partition_by:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    else:
        rows.write.mode("append").parquet(path)


def write_results(result: DataFrame, path: str, run_id: str) -> DataFrame:
    """SNK-2: persist the full result under ``run_id=<id>`` and return the
    re-read frame (a written table as the lineage cut). A retry with the same
    run id replaces its rows."""
    spark = result.sparkSession
    append_ledger(result.withColumn("run_id", F.lit(run_id)), path, ["run_id"])
    return spark.read.parquet(path).filter(F.col("run_id") == run_id)


def json_rows(df: DataFrame, out: str = "json") -> DataFrame:
    """SNK-4: one JSON text per row; nulls kept, timestamps ISO."""
    return df.select(F.to_json(F.struct(*df.columns),
                               {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
                                "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias(out))
