"""Penalty projections and violation roll-ups (PRJ-4..8, RUL-5/6, AGG-15/16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant import terms
from covenant.functions.columns import nan_to_null, positive_or_zero, tiered


def penalty_columns(df: DataFrame, word: str = "penalty") -> list[str]:
    """Result columns treated as penalties: name contains ``word`` (any case)."""
    return [c for c in df.columns if word in c.lower()]


def uptime_tier_penalty(uptime: Column, tiers=None, most_severe_first: bool = True) -> Column:
    """Uptime ladder. The contract lists tiers mildest first; evaluated in that
    order a first-match CASE never reaches the deeper tiers, so by default
    the most severe (lowest) threshold is tested first."""
    tiers = tiers or terms.UPTIME_TIERS
    pairs = [(t, amt) for t, _pct, amt in tiers]
    pairs = sorted(pairs, key=lambda p: p[0]) if most_severe_first else pairs
    return tiered(uptime, pairs, "<")


def response_tier_penalty(rt: Column, tiers=None, most_severe_first: bool = True) -> Column:
    tiers = tiers or terms.RESPONSE_TIERS
    pairs = [(t, amt) for t, _pct, amt in tiers]
    pairs = sorted(pairs, key=lambda p: -p[0]) if most_severe_first else pairs
    return tiered(rt, pairs, ">")


def uptime_proportional(uptime: Column) -> Column:
    return F.when(uptime < terms.UPTIME_TARGET,
                  (F.lit(100.0) - uptime) * terms.UPTIME_PROPORTIONAL_RATE).otherwise(F.lit(0.0))


def response_proportional(rt: Column) -> Column:
    return F.when(rt > terms.RESPONSE_TARGET_SECONDS,
                  (rt - terms.RESPONSE_TARGET_SECONDS) * terms.RESPONSE_PROPORTIONAL_RATE).otherwise(F.lit(0.0))


def with_row_penalty(df: DataFrame, cols: Sequence[str] | None = None,
                     out: str = "total_penalty") -> DataFrame:
    """RUL-5: per-row sum of the positive penalty cells (NaN/null count as 0)."""
    cols = list(cols) if cols is not None else penalty_columns(df)
    total = F.lit(0.0)
    for c in cols:
        total = total + positive_or_zero(F.col(c))
    return df.withColumn(out, total)


def violation_summary(df: DataFrame, row_penalty: str = "total_penalty") -> DataFrame:
    """AGG-15: rows with a positive penalty, their total, rows analysed.

    Runs over the whole result (not a displayed sample); a single global
    aggregate with map-side partial aggregation, so only one small row per
    task is shuffled.
    """
    p = F.col(row_penalty)
    return df.agg(
        F.count_if(p > 0).alias("violating_rows"),
        F.round(F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)), 4).alias("total_penalty"),
        F.count(F.lit(1)).alias("rows_analyzed"),
    )


def proof_violation_rate(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """AGG-16: violations counted per penalty *cell*, rate over rows."""
    cols = list(cols) if cols is not None else penalty_columns(df)
    cells = F.lit(0)
    pen = F.lit(0.0)
    for c in cols:
        v = nan_to_null(F.col(c))
        cells = cells + F.when(v > 0, 1).otherwise(0)
        pen = pen + F.when(v > 0, v).otherwise(0.0)
    agg = df.agg(
        F.sum(cells).cast("bigint").alias("violating_cells"),
        F.coalesce(F.sum(pen), F.lit(0.0)).alias("total_penalty"),
        F.count(F.lit(1)).alias("rows_analyzed"),
    )
    return agg.select(
        F.coalesce("violating_cells", F.lit(0).cast("bigint")).alias("violating_cells"),
        F.round("total_penalty", 4).alias("total_penalty"),
        "rows_analyzed",
        F.round(F.coalesce("violating_cells", F.lit(0)) / F.greatest(F.col("rows_analyzed"), F.lit(1)) * 100, 4)
         .alias("violation_rate_pct"),
    )


# FIXED VALUES: labels shown for penalty columns, matched by name word in order
RULE_LABELS = [("uptime", "Uptime SLA"), ("response", "Response Time SLA"), ("error", "Error Rate SLA")]


def with_rule_labels(df: DataFrame, cols: Sequence[str] | None = None,
                     row_penalty: str = "total_penalty") -> DataFrame:
    """RUL-6: violated-rule labels from penalty column names plus a status."""
    cols = list(cols) if cols is not None else penalty_columns(df)
    labels = []
    for c in cols:
        label = next((lab for word, lab in RULE_LABELS if word in c.lower()), None)
        if label is not None:
            labels.append(F.when(nan_to_null(F.col(c)) > 0, F.lit(label)))
    arr = F.array_compact(F.array(*labels)) if labels else F.array().cast("array<string>")
    joined = F.concat_ws(", ", arr)
    return (df.withColumn("violated_rules",
                          F.when(joined == "", F.lit("No violations")).otherwise(joined))
              .withColumn("status", F.when(F.col(row_penalty) > 0, F.lit("VIOLATION"))
                                     .otherwise(F.lit("Compliant"))))


def tiered_pct(value: Column, tiers, op: str) -> Column:
    """Credit percentage of the most severe matching tier."""
    rev = op.strip() in (">", ">=")
    pairs = sorted(((t, pct) for t, pct, _amt in tiers), key=lambda p: p[0], reverse=rev)
    return tiered(value, pairs, op)


def pct_of_fee(pct: Column, fee: float | Column = terms.MONTHLY_SERVICE_FEE) -> Column:
    """RUL-3: penalty = percentage / 100 × monthly fee."""
    f = fee if isinstance(fee, Column) else F.lit(float(fee))
    return pct / 100 * f
