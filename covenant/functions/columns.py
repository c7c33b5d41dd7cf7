"""Column-expression helpers (pure JVM-side expressions, no UDFs)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "=": lambda a, b: a == b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<>": lambda a, b: a != b,
}


def compare(left: Column, op: str, right) -> Column:
    """Comparison with the operator given as text (``<``, ``>=``, ``=`` …)."""
    try:
        return _OPS[op.strip()](left, right)
    except KeyError as e:
        raise ValueError(f"unsupported threshold operator {op!r}") from e


def tiered(value: Column, tiers: Sequence[tuple[float, float]], op: str) -> Column:
    """First-match tier ladder, like a SQL ``CASE``: tiers are tried in order.

    ``tiers`` is ``[(threshold, amount), ...]``; rows matching none get 0.
    """
    expr = None
    for threshold, amount in tiers:
        cond = compare(value, op, F.lit(threshold))
        expr = F.when(cond, F.lit(float(amount))) if expr is None else expr.when(cond, F.lit(float(amount)))
    return expr.otherwise(F.lit(0.0)) if expr is not None else F.lit(0.0)


def most_severe_first(tiers: Iterable[tuple[float, float]], op: str) -> list[tuple[float, float]]:
    """Order a tier list so the most severe threshold is tested first.

    For ``<`` the lowest threshold is the most severe; for ``>`` the highest.
    """
    rev = op.strip() in (">", ">=")
    return sorted(tiers, key=lambda t: t[0], reverse=rev)


def nan_to_null(c: Column) -> Column:
    """NaN compares greater than every number in Spark; make it null first."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def positive_or_zero(c: Column) -> Column:
    v = nan_to_null(c)
    return F.when(v > 0, v).otherwise(F.lit(0.0))


def sql_list(values: Iterable[str]) -> str:
    """Render strings as a SQL list literal body: 'a', 'b'."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
