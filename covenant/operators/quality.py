"""Data-quality checks on a result frame (DQ-1..12).

All per-column metrics come from one aggregate pass, plus one exact-distinct
pass over the columns whose check needs it; checks are then generated as rows ``(column_name, check, severity,
value, detail)`` — only the checks that fire are kept, as in a report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.operators.profile import DISTINCT_HASH_OVER, distinct_counts, kind_of

#: Relative error of the distinct sketch, and the share of rows from which a column may be all unique.
SKETCH_ERROR = 0.02
UNIQUE_FROM = 0.85
NULL_WARN_PCT = 50.0
LARGE_VALUE = 1e10

REPORT_SCHEMA = "column_name string, check string, severity string, value double, detail string"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _check(col: str, check: str, severity: str, value: str, detail: str | None, fires: str) -> str:
    """One check as SQL struct text (built as text: one expression per
    check instead of dozens of client round trips)."""
    return (f"named_struct('column_name', {_lit(col)}, 'check', {_lit(check)}, 'severity', {severity}, "
            f"'value', CAST({value} AS DOUBLE), 'detail', {detail or 'CAST(NULL AS STRING)'}, 'fires', {fires})")


def dq_report(df: DataFrame) -> DataFrame:
    """DQ-1..9 of all columns.

    The one aggregate pass also decides which columns need an exact distinct
    count: a constant column is known from its bounds, a string column with
    nulls or with a sketched count well below its rows cannot be all unique.
    Only id-like columns and the remaining string columns are counted exactly.
    """
    fields = df.schema.fields
    aggs = ["count(1) AS _rows"]
    id_like, strings = [], []
    for i, f in enumerate(fields):
        c, k = _q(f.name), kind_of(f.dataType)
        if k == "numeric":      # NaN counts as null
            c = f"CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) THEN {c} END"
        aggs += [f"count_if(({c}) IS NULL) AS z{i}", f"count({c}) AS n{i}"]
        if k == "numeric":
            aggs += [f"count_if(({c}) < 0) AS neg{i}", f"max(CAST(({c}) AS DOUBLE)) AS mx{i}"]
            if "id" in f.name.lower():
                id_like.append(i)
                aggs.append(f"min({c}) = max({c}) AS one{i}")
        if k == "datetime":
            aggs += [f"min(CAST({c} AS TIMESTAMP_NTZ)) AS lo{i}", f"max(CAST({c} AS TIMESTAMP_NTZ)) AS hi{i}"]
        if k == "string":
            strings.append(i)
            key = f"CASE WHEN length({c}) > {DISTINCT_HASH_OVER} THEN sha2({c}, 256) ELSE {c} END"
            aggs += [f"min({key}) = max({key}) AS one{i}", f"approx_count_distinct({key}, {SKETCH_ERROR}) AS est{i}"]
    wide = df.agg(*[F.expr(a) for a in aggs])
    row = wide.first()
    wide = df.sparkSession.createDataFrame([tuple(row)], wide.schema)
    exact = [i for i in id_like if row[f"n{i}"] and not row[f"one{i}"]]
    exact += [i for i in strings if row[f"n{i}"] == row["_rows"] > 0 and not row[f"one{i}"] and row[f"est{i}"] >= UNIQUE_FROM * row["_rows"]]
    if exact:
        names = [fields[i].name for i in exact]
        # one pivoted row: a single aggregate over ≤ #columns rows
        piv = distinct_counts(df, names).groupBy().pivot("column_name", names).agg(F.first("unique_values"))
        piv = piv.select(*[F.col(_q(c)).alias(f"u{i}") for i, c in zip(exact, names)])
        both = wide.unionByName(piv, allowMissingColumns=True)
        wide = both.agg(*[F.expr(f"max({c}) AS {c}") for c in both.columns])
    # the exact count, 1 where the bounds tell it, unknown (and then no check can fire) otherwise
    uq = {fields[i].name: f"coalesce(u{i}, 0)" if i in exact else "1" if row[f"one{i}"] else "CAST(NULL AS BIGINT)" for i in id_like + strings}
    checks = [_check("*", "has_results", "'warning'", "_rows", "'Query returned no results'", "_rows = 0"),
              _check("*", "total_nulls", "'metric'", " + ".join([f"z{i}" for i in range(len(fields))] or ["0"]),
                     None, "_rows > 0")]
    for i, f in enumerate(fields):
        k = kind_of(f.dataType)
        pct = f"round(try_divide(z{i}, _rows) * 100, 4)"
        checks.append(_check(f.name, "null_pct", f"CASE WHEN {pct} > {NULL_WARN_PCT} THEN 'warning' ELSE 'info' END",
                             pct, None, f"_rows > 0 AND z{i} > 0"))
        if k == "numeric":
            checks.append(_check(f.name, "negative_values", "'info'", f"neg{i}", None, f"n{i} > 0 AND neg{i} > 0"))
            checks.append(_check(f.name, "very_large_values", "'info'", f"mx{i}", None,
                                 f"n{i} > 0 AND mx{i} > {LARGE_VALUE}"))
            if f.name in uq:
                dup = f"(n{i} - {uq[f.name]})"
                checks.append(_check(f.name, "id_duplicates", "'info'", dup, None, f"n{i} > 0 AND {dup} > 0"))
        elif k == "datetime":
            checks.append(_check(f.name, "date_span", "'info'", f"timestampdiff(DAY, lo{i}, hi{i})",
                                 f"concat_ws(' to ', CAST(lo{i} AS STRING), CAST(hi{i} AS STRING))", f"n{i} > 0"))
        elif k == "string":
            u = uq[f.name]
            checks.append(_check(f.name, "constant", "'info'", u, None, f"_rows > 0 AND {u} = 1"))
            checks.append(_check(f.name, "all_unique", "'info'", u, None, f"_rows > 0 AND {u} <> 1 AND {u} = _rows"))
    report = wide.selectExpr(f"inline(array({', '.join(checks)}))")
    return report.filter("fires").drop("fires")


def dq_status(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    """DQ-10: 'warning' when any check warns, else 'passed'."""
    by = by or []
    warn = F.max(F.when(F.col("severity") == "warning", 1).otherwise(0))
    g = report.groupBy(*by) if by else report.groupBy()
    return g.agg(F.when(warn == 1, "warning").otherwise("passed").alias("sanity_status"),
                 F.count_if(F.col("severity") == "warning").alias("warnings"),
                 F.count_if(F.col("severity") == "info").alias("infos"))


def cost_checks(totals: DataFrame, type_col: str = "cost_type", amount_col: str = "amount") -> DataFrame:
    """DQ-11/12: negative totals warn (except the grand total), NaN/null is an error."""
    a = F.col(amount_col)
    bad = a.isNull() | F.isnan(a.cast("double"))
    neg = (F.col(type_col) != "all") & (a < 0)
    return (totals.select(type_col, amount_col,
                          F.when(bad, "error").when(neg, "warning").alias("severity"),
                          F.when(bad, "invalid_amount").when(neg, "negative_cost").alias("check"))
            .filter(F.col("severity").isNotNull()))
