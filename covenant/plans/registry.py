"""Registry of named queries and their DuckDB oracle statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
INVENTORY: dict[str, tuple[str, ...]] = {}


def register(name: str, ids: tuple[str, ...] | str = (), oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``oracle`` is an SQL statement over the raw test tables computing the same
    result; leave it out only for work SQL cannot express.
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        INVENTORY[name] = (ids,) if isinstance(ids, str) else tuple(ids)
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn
    return deco
