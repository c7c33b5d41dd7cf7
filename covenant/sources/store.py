"""A keyed record store on shared files (SNK-3, SRC-6, FLT-6): last write wins.

Records lie in ``buckets`` folders by a hash of their key. A version is a
manifest: for every bucket, the folder that holds its records. An upsert writes
new folders for the buckets that it touches and then one manifest file, which
names these and, for all other buckets, the folders they already had. The
manifest appears by the rename of a single file, so a reader has the old version
or the new one, never a mix, and a reader that began before goes on with the
folders of its version, which are never changed. A lookup reads the buckets of
its keys only.

One writer at a time. An upsert that dies leaves folders that no manifest names;
its retry overwrites them. Null keys are a key like any other. Folders of old
versions can be removed by age.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.operators.windows import latest_per_key

MANIFEST = "version long, bucket int, folder string"


@dataclass(frozen=True)
class RecordStore:
    """A store of records with columns ``schema``, one per ``key``; the record with the greatest ``order`` is kept."""

    path: str
    schema: T.StructType
    key: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.key]), F.lit(self.buckets)).cast("int")

    def _manifest(self, spark: SparkSession, version: int | None = None) -> tuple[int, dict[int, str]]:
        """The latest version, or that given, and the folder of each bucket; version 0 is empty."""
        try:
            rows = spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").collect()       # a row per bucket and version
        except AnalysisException:
            return 0, {}
        versions = {r["version"] for r in rows}
        if version is None:
            version = max(versions, default=0)
        elif version not in versions:
            raise ValueError(f"the store has no version {version}")
        return version, {r["bucket"]: r["folder"] for r in rows if r["version"] == version}

    def _read(self, spark: SparkSession, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def version(self, spark: SparkSession) -> int:
        return self._manifest(spark)[0]

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """All records of the latest version, or of an earlier one."""
        return self._read(spark, list(self._manifest(spark, version)[1].values()))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The records whose key stands in ``keys``; reads only the buckets these fall into."""
        spark = keys.sparkSession
        wanted = keys.select(*[F.col(f"`{k}`") for k in self.key]).distinct()
        named = self._manifest(spark)[1]
        touched = {r[0] for r in wanted.select(self.bucket()).distinct().collect()}              # at most a number per bucket
        found = self._read(spark, [f for b, f in named.items() if b in touched])
        wanted = wanted.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(self.key)])
        return found.join(wanted, [found[f"`{k}`"].eqNullSafe(wanted[f"_k{i}"]) for i, k in enumerate(self.key)], "left_semi")

    def upsert(self, incoming: DataFrame) -> int:
        """Adds records, the greatest ``order`` per key winning; returns the new version. Without records the version stays."""
        spark = incoming.sparkSession
        version, named = self._manifest(spark)
        rows = incoming.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema.fields])
        rows = self._latest(rows)                                                               # reduced before it meets the store
        touched = sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())
        if not touched:
            return version
        merged = self._latest(rows.union(self._read(spark, [named[b] for b in touched if b in named])))
        folder = f"data/version={version + 1}"
        (merged.withColumn("store_bucket", self.bucket()).repartition(len(touched), "store_bucket")
         .write.mode("overwrite").partitionBy("store_bucket").parquet(f"{self.path}/{folder}"))
        now = named | {b: f"{folder}/store_bucket={b}" for b in touched}
        switch = spark.createDataFrame([(version + 1, b, f) for b, f in sorted(now.items())], MANIFEST).coalesce(1)
        switch.write.mode("append").parquet(f"{self.path}/manifest")
        return version + 1

    def _latest(self, rows: DataFrame) -> DataFrame:
        names = [f.name for f in self.schema.fields]
        return latest_per_key(rows, list(self.key), list(self.order), [c for c in names if c not in self.key]).select(*names)
