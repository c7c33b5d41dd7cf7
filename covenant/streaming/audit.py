"""Audit trail as a stream (AUD-7): append with the previous event of the same entity.

Every micro-batch is appended under its batch id together with the state after
it, the newest event of each entity. A batch takes the state that the batch
before it left, so a batch that is run again, after a failure between its writes
or after the stream's own restart, reads the same state and replaces what it had
written: nothing is added twice, and the timeline is the same.

An event older than the newest event of its entity in earlier batches arrived
late: it is kept, marked ``late``, and its previous event is not known.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.operators.windows import latest_per_key, previous_in_order


class AuditTrail:
    """Writes batches of events below ``path``; ``entity`` names the key, ``order`` a total order by time, ``carry`` what the next event gets."""

    def __init__(self, path: str, schema: T.StructType, entity: Sequence[str], order: Sequence[str], carry: Sequence[str]):
        self.path, self.schema = path.rstrip("/"), schema
        self.entity, self.order, self.carry = list(entity), list(order), list(carry)

    def _state_columns(self) -> list[str]:
        return list(dict.fromkeys([*self.entity, *self.order, *self.carry]))

    def state(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The newest event of every entity after a batch; empty before the first."""
        schema = T.StructType([self.schema[c] for c in self._state_columns()])
        try:
            return spark.read.schema(schema).parquet(f"{self.path}/state/batch={batch_id}")
        except AnalysisException:
            return spark.createDataFrame([], schema)

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Appends one batch; running the same batch again leaves the same files' contents."""
        spark = batch.sparkSession
        before = self.state(spark, batch_id - 1)
        names = self._state_columns()
        known = before.select(*[F.col(c).alias(f"_s_{c}") for c in names])
        rows = batch.select(*self.schema.fieldNames())
        # the batch's own events in order, split by the minute
        own = previous_in_order(rows, self.entity, self.order, list(dict.fromkeys([*self.order, *self.carry])),
                                chunk=F.date_trunc("minute", self.order[0]))
        joined = own.join(known, [own[c].eqNullSafe(known[f"_s_{c}"]) for c in self.entity], "left")
        newer = F.struct(*[F.col(c) for c in self.order]) > F.struct(*[F.col(f"_s_{c}") for c in self.order])
        late = F.coalesce(~newer, F.lit(False)) & F.col(f"_s_{self.order[0]}").isNotNull()
        # the previous event in the batch counts only if it is not itself older than the state
        inside = F.struct(*[F.col(f"prev_{c}") for c in self.order]) > F.struct(*[F.col(f"_s_{c}") for c in self.order])
        has_prev, has_state = F.col(f"prev_{self.order[0]}").isNotNull(), F.col(f"_s_{self.order[0]}").isNotNull()
        out = [F.col(c) for c in self.schema.fieldNames()]
        for c in self.carry:
            out.append(F.when(late, F.lit(None)).when(has_prev & (~has_state | F.coalesce(inside, F.lit(False))), F.col(f"prev_{c}"))
                       .otherwise(F.col(f"_s_{c}")).alias(f"prev_{c}"))
        joined.select(*out, late.alias("late")).write.mode("overwrite").parquet(f"{self.path}/trail/batch={batch_id}")
        after = latest_per_key(before.unionByName(rows.select(*names)), self.entity, self.order, [c for c in names if c not in self.entity])
        after.write.mode("overwrite").parquet(f"{self.path}/state/batch={batch_id}")

    def run(self, source: str, checkpoint: str) -> None:
        """Appends the new files of ``source`` and returns; a later call goes on where this one ended."""
        spark = SparkSession.active()
        stream = spark.readStream.schema(self.schema).parquet(source)
        (stream.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())

    def timeline(self, spark: SparkSession) -> DataFrame:
        """All appended events with their previous ones."""
        return spark.read.parquet(f"{self.path}/trail")
