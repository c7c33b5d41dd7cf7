"""Join helpers: size-checked broadcast and zone-free time numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Hint a broadcast only after proving the side has at most ``max_rows``
    rows (a ``limit(max_rows + 1)`` count, cheap even on a large input);
    beyond that the frame is returned as is and the planner/AQE picks a
    shuffle join from runtime sizes."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def micros(ts: Column) -> Column:
    """Microseconds since 1970 for a TIMESTAMP_NTZ, independent of session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            ts.cast("timestamp_ntz"))
