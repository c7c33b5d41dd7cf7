"""Cost roll-ups (AGG-7..13, JN-5, SET-1).

Cost columns are found from the schema (names only), then unpivoted to a
long ``(cost_type, column_name, amount)`` frame so every roll-up is one
partially-aggregated group-by, whatever the number of cost columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant import terms

#: Amounts up to 24 digits before the point; sums keep four decimals exactly.
MONEY = "decimal(28,4)"


#: What names a column's cost type: (type, text in the name, rank); a type's
#: columns are those of its best-ranked text.
COST_NAME_RULES = [(t, f"_{t}", 0) for t in terms.COST_TYPES] + \
    [(t, word, 1) for t, words in terms.COST_COMMON_WORDS for word in words]


def detect_cost_columns(columns: Sequence[str]) -> dict[str, list[str]]:
    """AGG-9: cost type → its columns, in the columns' order."""
    hits = {(t, rank, i) for i, c in enumerate(columns) for t, text, rank in COST_NAME_RULES if text in c.lower()}
    best = {t: min(r for u, r, _ in hits if u == t) for t, _, _ in hits}
    return {t: [columns[i] for u, r, i in sorted(hits) if u == t and r == best[t]]
            for t in dict.fromkeys(t for t, _, _ in COST_NAME_RULES) if t in best}


def cost_cells(df: DataFrame, detected: dict[str, list[str]] | None = None) -> DataFrame:
    """Unpivot detected cost columns to (cost_type, column_name, amount, lost).

    ``lost`` tells that a cell has a value which is no amount of at most 24
    digits before the point; such a cell counts as 0 in sums."""
    detected = detected if detected is not None else detect_cost_columns(df.columns)
    def lenient(c):
        # TYP-7: numbers cast directly, anything else parsed from text; bad → null
        if isinstance(df.schema[c].dataType, T.NumericType):
            return F.col(f"`{c}`").try_cast(MONEY)
        return F.col(f"`{c}`").cast("string").try_cast(MONEY)
    def cell(t, c):
        return F.struct(F.lit(t).alias("cost_type"), F.lit(c).alias("column_name"), lenient(c).alias("amount"),
                        (F.col(f"`{c}`").isNotNull() & lenient(c).isNull()).alias("lost"))
    cells = [cell(t, c)
             for t, cols in detected.items() for c in cols]
    if not cells:
        return df.sparkSession.createDataFrame([], f"cost_type string, column_name string, amount {MONEY}, lost boolean")
    return df.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def cost_by_type(df: DataFrame, detected: dict[str, list[str]] | None = None) -> DataFrame:
    """AGG-7: total per type (unparseable → 0, counted in ``lost_values``),
    average over *all* rows, and the source columns — one aggregate: every row yields one cell per
    detected column, so rows = cells of a type / its column count."""
    detected = detected if detected is not None else detect_cost_columns(df.columns)
    long = cost_cells(df, detected)
    width = F.create_map(*[x for t, cs in detected.items() for x in (F.lit(t), F.lit(len(cs)))]) \
        if detected else F.create_map().cast("map<string,int>")
    cols_txt = F.create_map(*[x for t, cs in detected.items() for x in (F.lit(t), F.lit(",".join(cs)))]) \
        if detected else F.create_map().cast("map<string,string>")
    tot = long.groupBy("cost_type").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("total"),
                                        F.count(F.lit(1)).alias("cells"), F.count_if("lost").alias("lost_values"))
    rows = F.col("cells") / width[F.col("cost_type")]
    return tot.select(
        "cost_type",
        F.col("total").cast("double").alias("total"),
        (F.col("total").cast("double") / rows).alias("average"),
        cols_txt[F.col("cost_type")].alias("columns"),
        "lost_values",
    )


#: Rows of a result that a cost extraction shows.
SAMPLE_ROWS = 10


def cost_extraction(df: DataFrame, order: Sequence[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """AGG-7..9 as one record: the detected types with their totals, averages and
    columns, the grand total over all of them, and the first ``rows`` rows by
    ``order`` as JSON. Without cost columns the types are empty and the total 0."""
    types = cost_by_type(df).select("cost_type", "total", "average", "columns", "lost_values")
    record = types.agg(F.array_sort(F.collect_list(F.struct(*types.columns))).alias("cost_types"),       # one entry a type
                       F.coalesce(F.sum(F.col("total").cast(MONEY)), F.lit(0)).cast("double").alias("grand_total"))
    first = df.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in order]).limit(rows)
    sample = [r[0] for r in first.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})).collect()]
    return record.withColumn("sample_rows", F.array(*[F.lit(x) for x in sample]).cast("array<string>"))


def totals_with_all(df: DataFrame, measure: str, type_col: str = "cost_type") -> DataFrame:
    """AGG-8: per-type totals plus the grand total ``all`` (a ROLLUP)."""
    g = df.rollup(type_col).agg(F.sum(measure).alias("_s"), F.grouping_id().alias("_g"))
    return g.select(F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col(type_col)).alias(type_col),
                    F.col("_s").cast("double").alias("amount"))


def cost_by_period(df: DataFrame) -> DataFrame:
    """AGG-10: monthly totals per type."""
    return (df.groupBy("period_start", "cost_type")
            .agg(F.sum("original_cost").cast("double").alias("original"),
                 F.sum("calculated_cost").cast("double").alias("calculated"),
                 F.sum("delta_cost").cast("double").alias("delta"),
                 F.count(F.lit(1)).alias("lines")))


def proof_summary(df: DataFrame) -> DataFrame:
    """AGG-11: totals, by type (original/calculated/delta), by currency
    (calculated; a missing currency counts as USD). Lines are summed by
    (type, currency) first, so GROUPING SETS expands that small result only."""
    cur = F.coalesce(F.col("cost_currency"), F.lit("USD")).alias("currency")
    pre = df.groupBy("cost_type", cur).agg(F.sum("original_cost").alias("original_cost"), F.sum("calculated_cost").alias("calculated_cost"),
                                           F.sum("delta_cost").alias("delta_cost"))
    g = (pre.groupingSets([[], ["cost_type"], ["currency"]], "cost_type", "currency")
         .agg(F.sum("original_cost").alias("o"), F.sum("calculated_cost").alias("c"),
              F.sum("delta_cost").alias("d"), F.grouping_id().alias("gid")))
    level = F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "by_type").otherwise("by_currency")
    return g.select(
        level.alias("level"),
        F.coalesce(F.col("cost_type"), F.col("currency"), F.lit("*")).alias("key"),
        F.when(F.col("gid") != 2, F.col("o")).cast("double").alias("original"),
        F.col("c").cast("double").alias("calculated"),
        F.when(F.col("gid") != 2, F.col("d")).cast("double").alias("delta"),
    )


def cost_type_stats(df: DataFrame, measure: str = "calculated_cost") -> DataFrame:
    """AGG-12: count, total, average, min, max per type."""
    m = F.col(measure)
    return df.groupBy("cost_type").agg(
        F.count(m).alias("count"), F.sum(m).cast("double").alias("total"),
        F.round(F.sum(m).cast("double") / F.count(m), 6).alias("average"),
        F.min(m).cast("double").alias("min"), F.max(m).cast("double").alias("max"))


def cost_summary(df: DataFrame, measure: str = "calculated_cost") -> DataFrame:
    """AGG-13: totals by type, by period and overall, from sums by (type, period)."""
    pre = df.groupBy("cost_type", "period_start").agg(F.sum(measure).alias("s"), F.count(F.lit(1)).alias("lines"))
    g = (pre.groupingSets([["cost_type"], ["period_start"], []], "cost_type", "period_start")
         .agg(F.sum("s").alias("s"), F.sum("lines").alias("lines"), F.grouping_id().alias("gid")))
    return g.select(
        F.when(F.col("gid") == 1, "by_type").when(F.col("gid") == 2, "by_period").otherwise("total").alias("level"),
        "cost_type", "period_start", F.col("s").cast("double").alias("amount"), "lines")


def cost_delta(original: DataFrame, calculated: DataFrame, key: str = "cost_type") -> DataFrame:
    """JN-5 / SET-1: delta over the union of keys; a missing side counts 0.

    Both inputs are per-key totals (pre-aggregated), so the full outer join
    shuffles one row per key, not per line."""
    j = original.alias("o").join(calculated.alias("c"), key, "full_outer")
    o = F.coalesce(F.col("o.amount"), F.lit(0.0))
    c = F.coalesce(F.col("c.amount"), F.lit(0.0))
    return j.select(key, o.alias("original"), c.alias("calculated"), (c - o).alias("delta"))
