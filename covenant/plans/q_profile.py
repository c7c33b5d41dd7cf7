"""Coercion, profiling and data-quality queries (TYP-*, AGG-1..6, DQ-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenant import terms
from covenant.functions.columns import sql_list
from covenant.operators import coercion as co
from covenant.operators import execution as ex
from covenant.operators import profile as pf
from covenant.operators import quality as dq
from covenant.plans import adapters as A
from covenant.plans.adapters import with_views
from covenant.plans.registry import register

RAW_TEXT_COLS = ["id_txt", "flag_txt", "amount_txt", "date_txt", "mixed_txt", "prio_txt", "empty_txt"]
BOOL_WORDS = sql_list(terms.BOOLEAN_WORDS)
TRUE_WORDS = sql_list(terms.TRUE_WORDS)
ISO_GUARD = r"'^\d{4}-\d{2}-\d{2}'"
NUM_GUARD = "'" + co.NUMBER_SHAPE + "'"


def _sql_num(c):
    return f"CASE WHEN regexp_matches({c}, {NUM_GUARD}) THEN TRY_CAST({c} AS DOUBLE) END"


def _sql_dt(c):
    return f"CASE WHEN regexp_matches({c}, {ISO_GUARD}) THEN TRY_CAST({c} AS TIMESTAMP) END"


def _decision_sql():
    parts = []
    for i, c in enumerate(RAW_TEXT_COLS):
        parts.append(f"""
SELECT '{c}' AS column_name, {i} AS position,
  CASE WHEN nn = 0 THEN 'string' WHEN nb = 0 AND bs <= 2 THEN 'boolean'
       WHEN num / nrows > 0.8 THEN 'numeric' WHEN dt / nrows > 0.8 THEN 'datetime' ELSE 'string' END AS detected_type,
  nrows AS total_rows, nn AS non_null, round(num / nrows, 6) AS numeric_ratio, round(dt / nrows, 6) AS datetime_ratio,
  nn - CASE WHEN nn = 0 THEN nn WHEN nb = 0 AND bs <= 2 THEN nn WHEN num / nrows > 0.8 THEN num
            WHEN dt / nrows > 0.8 THEN dt ELSE nn END AS lost_values
FROM (SELECT count(*) AS nrows, count({c}) AS nn,
             count(*) FILTER (WHERE {c} IS NOT NULL AND lower({c}) NOT IN ({BOOL_WORDS})) AS nb,
             count(DISTINCT CASE WHEN lower({c}) IN ({BOOL_WORDS}) THEN {c} END) AS bs,
             count({_sql_num(c)}) AS num, count({_sql_dt(c)}) AS dt
      FROM raw_orders_text) s""")
    return "\nUNION ALL".join(parts)


@register("coerce_decisions", ("TYP-1", "TYP-2", "TYP-3", "TYP-4"),
          oracle=with_views(_decision_sql(), "raw_orders_text"))
def coerce_decisions(spark, d):
    return co.decide(A.raw_orders_text(spark, d), RAW_TEXT_COLS)


COERCED_SQL = f"""
SELECT order_key, {_sql_num('id_txt')} AS id_txt,
       CASE WHEN flag_txt IS NULL THEN NULL ELSE lower(flag_txt) IN ({TRUE_WORDS}) END AS flag_txt,
       {_sql_num('amount_txt')} AS amount_txt, {_sql_dt('date_txt')} AS date_txt,
       mixed_txt, prio_txt, empty_txt
FROM raw_orders_text"""


def coerced(spark, d):
    df, _dec = co.coerce(A.raw_orders_text(spark, d), RAW_TEXT_COLS)
    return df


@register("coerce_frame", "TYP-4", oracle=with_views(COERCED_SQL, "raw_orders_text"))
def coerce_frame(spark, d):
    return coerced(spark, d)


@register("coerce_bool", "TYP-1", oracle=with_views(
    f"SELECT order_key, flag_txt AS flag FROM ({COERCED_SQL}) c", "raw_orders_text"))
def coerce_bool(spark, d):
    return coerced(spark, d).select("order_key", F.col("flag_txt").alias("flag"))


@register("coerce_numeric", "TYP-2", oracle=with_views(
    f"SELECT order_key, amount_txt AS amount, id_txt AS id_num FROM ({COERCED_SQL}) c", "raw_orders_text"))
def coerce_numeric(spark, d):
    return coerced(spark, d).select("order_key", F.col("amount_txt").alias("amount"),
                                    F.col("id_txt").alias("id_num"))


@register("coerce_datetime", "TYP-3", oracle=with_views(
    f"SELECT order_key, date_txt AS order_date FROM ({COERCED_SQL}) c", "raw_orders_text"))
def coerce_datetime(spark, d):
    return coerced(spark, d).select("order_key", F.col("date_txt").alias("order_date"))


def _label_sql(v):
    return (f"CASE WHEN {v} IS NULL OR lower({v}) IN ({sql_list(terms.NULL_WORDS)}) THEN 'string' "
            f"WHEN lower({v}) IN ('true', 'false', '1', '0') THEN 'boolean' "
            f"WHEN ({_sql_num(v)}) IS NOT NULL THEN CASE WHEN contains({v}, '.') THEN 'float' ELSE 'integer' END "
            f"WHEN (contains({v}, '-') OR contains({v}, '/')) AND length({v}) IN (10, 19) THEN 'date' "
            f"ELSE 'string' END")


@register("type_labels", "TYP-5", oracle=with_views(f"""
SELECT column_name, {_label_sql('v')} AS type_label, count(*) AS n
FROM (UNPIVOT (SELECT {', '.join(RAW_TEXT_COLS[:-1])} FROM raw_orders_text)
      ON {', '.join(RAW_TEXT_COLS[:-1])} INTO NAME column_name VALUE v) u
GROUP BY ALL""", "raw_orders_text"))
def type_labels(spark, d):
    raw = A.raw_orders_text(spark, d)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v"))
                                for c in RAW_TEXT_COLS[:-1]]))
    long = raw.select(cells.alias("_c")).select("_c.column_name", "_c.v").filter(F.col("v").isNotNull())
    return long.groupBy("column_name", co.value_label(F.col("v")).alias("type_label")).agg(
        F.count(F.lit(1)).alias("n"))


@register("column_labels", "TYP-6", oracle=with_views(f"""
SELECT * FROM (VALUES (0, 'order_key', 'integer'), (1, 'id_txt', 'float'), (2, 'flag_txt', 'boolean'),
                      (3, 'amount_txt', 'float'), (4, 'date_txt', 'date')) t(position, column_name, type_label)
UNION ALL SELECT 5, 'mixed_txt', coalesce({_label_sql('s')}, 'string')
  FROM (SELECT arg_min(mixed_txt, order_key) FILTER (WHERE mixed_txt IS NOT NULL) AS s FROM raw_orders_text)
UNION ALL SELECT 6, 'prio_txt', coalesce({_label_sql('s')}, 'string')
  FROM (SELECT arg_min(prio_txt, order_key) FILTER (WHERE prio_txt IS NOT NULL) AS s FROM raw_orders_text)
UNION ALL SELECT 7, 'empty_txt', 'string'""", "raw_orders_text"))
def column_labels(spark, d):
    return co.column_labels(coerced(spark, d), "order_key")


@register("lenient_costs", "TYP-7", oracle=with_views("""
SELECT prio_txt, CAST(coalesce(sum(TRY_CAST(amount_txt AS DECIMAL(18,4))), 0) AS DOUBLE) AS total,
       count(TRY_CAST(amount_txt AS DECIMAL(18,4))) AS valid_values,
       count(*) - count(TRY_CAST(amount_txt AS DECIMAL(18,4))) AS invalid_values
FROM raw_orders_text GROUP BY prio_txt""", "raw_orders_text"))
def lenient_costs(spark, d):
    raw = A.raw_orders_text(spark, d)
    v = F.col("amount_txt").try_cast("decimal(18,4)")
    return raw.groupBy("prio_txt").agg(
        F.coalesce(F.sum(v), F.lit(0)).cast("double").alias("total"),
        F.count(v).alias("valid_values"),
        (F.count(F.lit(1)) - F.count(v)).alias("invalid_values"))


# ------------------------------------------------------------------ profiles
BILLING_NUMERIC = ["l_orderkey", "l_linenumber", "uptime_percent", "avg_response_time", "error_rate",
                   "transaction_count"]
BILLING_TYPES = {"l_orderkey": "bigint", "l_linenumber": "int", "uptime_percent": "double",
                 "avg_response_time": "double", "error_rate": "double", "transaction_count": "bigint"}


def _numeric_sql():
    parts = []
    for c in BILLING_NUMERIC:
        x = f"(CAST({c} AS DOUBLE) + 0.0)"
        sx = (f"CAST(sum({c}) AS DOUBLE)" if BILLING_TYPES[c] in ("bigint", "int")
              else f"CAST(sum(CAST({c} AS DECIMAL(38,10))) AS DOUBLE)")
        parts.append(f"""
SELECT '{c}' AS column_name, '{BILLING_TYPES[c]}' AS type, count({x}) AS count,
       count(*) FILTER (WHERE {c} IS NULL) AS null_count, min({x}) AS min, max({x}) AS max,
       round({sx} / count({x}), 6) AS mean, round(median({x}), 6) AS median,
       round({sx}, 6) AS sum, round(stddev_samp({x}), 6) AS std
FROM billing""")
    return "\nUNION ALL".join(parts)


@register("numeric_profile", "AGG-1", oracle=with_views(_numeric_sql(), "billing"))
def numeric_profile(spark, d):
    return pf.numeric_profile(A.billing(spark, d), BILLING_NUMERIC)


@register("datetime_profile", "AGG-2", oracle=with_views("""
SELECT 'detected_at' AS column_name, count(detected_at) AS count, count(*) FILTER (WHERE detected_at IS NULL) AS null_count,
       CAST(min(detected_at) AS VARCHAR) AS min, CAST(max(detected_at) AS VARCHAR) AS max,
       date_sub('day', min(detected_at), max(detected_at)) AS range_days FROM incidents
UNION ALL
SELECT 'resolved_at', count(resolved_at), count(*) FILTER (WHERE resolved_at IS NULL),
       CAST(min(resolved_at) AS VARCHAR), CAST(max(resolved_at) AS VARCHAR),
       date_sub('day', min(resolved_at), max(resolved_at)) FROM incidents""", "incidents"))
def datetime_profile(spark, d):
    return pf.datetime_profile(A.incidents(spark, d), ["detected_at", "resolved_at"])


DOC_STRINGS = ["text", "lang", "source"]


@register("string_profile", "AGG-3", oracle="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
    f"count(DISTINCT {c}) AS unique_values, CAST(coalesce(max(length({c})), 0) AS BIGINT) AS max_length FROM documents"
    for c in DOC_STRINGS))
def string_profile(spark, d):
    return pf.string_profile(A.table(spark, d, "documents"), DOC_STRINGS)


@register("boolean_counts", "AGG-4", oracle=with_views(f"""
SELECT 'sla_breached' AS column_name, sla_breached AS value, count(*) AS count FROM incidents
WHERE sla_breached IS NOT NULL GROUP BY sla_breached
UNION ALL
SELECT 'flag_txt', flag_txt, count(*) FROM ({COERCED_SQL}) c WHERE flag_txt IS NOT NULL GROUP BY flag_txt""",
    "incidents", "raw_orders_text"))
def boolean_counts(spark, d):
    a = pf.boolean_counts(A.incidents(spark, d), ["sla_breached"])
    b = pf.boolean_counts(coerced(spark, d), ["flag_txt"])
    return a.unionByName(b)


APPROVAL_KINDS = [("id", "numeric"), ("calculation_id", "numeric"), ("request_status", "string"),
                  ("approved_by", "numeric"), ("approval_date", "datetime"), ("requires_escalation", "boolean"),
                  ("approver_comments", "string")]


def _statistics_sql(view, kinds, types):
    """The long statistics table of a view, column by column."""
    parts = [f"SELECT '*' AS column_name, 'frame' AS kind, 'total_columns' AS stat, CAST({len(kinds)} AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text"]
    for c, k in kinds:
        x = f"(CAST({c} AS DOUBLE) + 0.0)"
        whole = types[c] in ("bigint", "int")
        total = f"CAST(sum({c}) AS DOUBLE)" if whole else f"CAST(sum(CAST({c} AS DECIMAL(38,10))) AS DOUBLE)"
        row = lambda stat, value, text="NULL", c=c, k=k: f"SELECT '{c}', '{k}', '{stat}', CAST({value} AS DOUBLE), CAST({text} AS VARCHAR) FROM {view}"
        parts += [row("type", "NULL", f"'{types[c]}'") + " LIMIT 1", row("count", f"count({c})"), row("null_count", f"count(*) - count({c})")]
        if k == "numeric":
            parts += [row(n, e) for n, e in (("min", f"min({x})"), ("max", f"max({x})"), ("mean", f"round({total} / count({c}), 6)"), ("sum", f"round({total}, 6)"),
                                             ("std", f"round(stddev_samp({x}), 6)"), ("median", f"round(median({x}), 6)"))]
        elif k == "datetime":
            parts += [row("min", "NULL", f"min(CAST({c} AS TIMESTAMP))"), row("max", "NULL", f"max(CAST({c} AS TIMESTAMP))"),
                      row("range_days", f"date_sub('day', min(CAST({c} AS TIMESTAMP)), max(CAST({c} AS TIMESTAMP)))")]
        elif k == "string":
            parts += [row("unique_values", f"count(DISTINCT {c})"), row("max_length", f"coalesce(max(length({c})), 0)")]
        else:
            parts += [row("true", f"count(*) FILTER (WHERE {c})"), row("false", f"count(*) FILTER (WHERE NOT {c})")]
    return "\nUNION ALL ".join(f"(SELECT * FROM ({p}) p)" for p in parts)


APPROVAL_TYPES = {"id": "bigint", "calculation_id": "bigint", "request_status": "string", "approved_by": "bigint",
                  "approval_date": "timestamp_ntz", "requires_escalation": "boolean", "approver_comments": "string"}


@register("full_profile", "AGG-5", oracle=with_views(_statistics_sql("approvals", APPROVAL_KINDS, APPROVAL_TYPES), "approvals"))
def full_profile(spark, d):
    return pf.column_statistics(A.approvals(spark, d))


COST_TYPES_SQL = {"l_orderkey": "bigint", "l_linenumber": "int", "calculation_id": "bigint", "cost_type": "string", "cost_currency": "string",
                  "original_cost": "decimal(18,2)", "calculated_cost": "decimal(18,4)", "delta_cost": "decimal(18,4)", "period_start": "date",
                  "period_end": "date", "cost_unit": "string", "cost_details": "string"}


@register("cost_statistics", "AGG-5", oracle=with_views(_statistics_sql("cost_breakdowns", [
    (c, "string" if t == "string" else "datetime" if t == "date" else "numeric") for c, t in COST_TYPES_SQL.items()], COST_TYPES_SQL), "cost_breakdowns"))
def cost_statistics(spark, d):
    """All statistics of the cost lines: amounts, types, currencies (missing for half of them), periods."""
    return pf.column_statistics(A.cost_breakdowns(spark, d))


@register("shape", "AGG-6", oracle=with_views("""
SELECT (SELECT count(*) FROM billing) AS input_rows, CAST(8 AS BIGINT) AS input_columns,
       (SELECT count(*) FROM billing
         WHERE (CASE WHEN uptime_percent < 99.0 THEN 1 ELSE 0 END) + (CASE WHEN avg_response_time > 2.0 THEN 1 ELSE 0 END) > 0)
         AS output_rows,
       CAST(6 AS BIGINT) AS output_columns""", "billing"))
def shape(spark, d):
    from covenant.plans.q_penalties import row_penalty_frame
    b = A.billing(spark, d)
    res = row_penalty_frame(spark, d).filter(F.col("total_penalty") > 0)
    return ex.shape(b, res)


# ------------------------------------------------------------------ quality
COST_KINDS = [("l_orderkey", "numeric"), ("l_linenumber", "numeric"), ("calculation_id", "numeric"),
              ("cost_type", "string"), ("cost_currency", "string"), ("original_cost", "numeric"),
              ("calculated_cost", "numeric"), ("delta_cost", "numeric"), ("period_start", "datetime"),
              ("period_end", "datetime"), ("cost_unit", "string"), ("cost_details", "string")]
USER_KINDS = [("id", "numeric"), ("username", "string"), ("email", "string"), ("role", "string"), ("is_active", "boolean")]
SCALED_KINDS = [("order_id", "numeric"), ("scaled_total", "numeric"), ("source", "string")]
SCALED_SQL = "(SELECT o_orderkey AS order_id, o_totalprice * 1000000 AS scaled_total, 'orders' AS source FROM orders)"


def _dq_sql(frame, view, kinds):
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c, _ in kinds)
    rows = [f"SELECT '{frame}' AS frame, '*' AS column_name, 'has_results' AS \"check\", 'warning' AS severity, "
            f"CAST(count(*) AS DOUBLE) AS value, 'Query returned no results' AS detail FROM {view} HAVING count(*) = 0",
            f"SELECT '{frame}', '*', 'total_nulls', 'metric', CAST({nulls} AS DOUBLE), NULL FROM {view} HAVING count(*) > 0"]
    for c, k in kinds:
        pct = f"round(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 4)"
        rows.append(f"SELECT '{frame}', '{c}', 'null_pct', CASE WHEN {pct} > 50 THEN 'warning' ELSE 'info' END, "
                    f"CAST({pct} AS DOUBLE), NULL FROM {view} "
                    f"HAVING count(*) > 0 AND count(*) FILTER (WHERE {c} IS NULL) > 0")
        if k == "numeric":
            rows.append(f"SELECT '{frame}', '{c}', 'negative_values', 'info', "
                        f"CAST(count(*) FILTER (WHERE {c} < 0) AS DOUBLE), NULL FROM {view} "
                        f"HAVING count({c}) > 0 AND count(*) FILTER (WHERE {c} < 0) > 0")
            rows.append(f"SELECT '{frame}', '{c}', 'very_large_values', 'info', max(CAST({c} AS DOUBLE)), NULL "
                        f"FROM {view} HAVING count({c}) > 0 AND max(CAST({c} AS DOUBLE)) > 1e10")
            if "id" in c.lower():
                rows.append(f"SELECT '{frame}', '{c}', 'id_duplicates', 'info', "
                            f"CAST(count({c}) - count(DISTINCT {c}) AS DOUBLE), NULL FROM {view} "
                            f"HAVING count({c}) > 0 AND count({c}) > count(DISTINCT {c})")
        elif k == "datetime":
            lo, hi = f"min(CAST({c} AS TIMESTAMP))", f"max(CAST({c} AS TIMESTAMP))"
            rows.append(f"SELECT '{frame}', '{c}', 'date_span', 'info', CAST(date_sub('day', {lo}, {hi}) AS DOUBLE), "
                        f"CAST({lo} AS VARCHAR) || ' to ' || CAST({hi} AS VARCHAR) FROM {view} HAVING count({c}) > 0")
        elif k == "string":
            rows.append(f"SELECT '{frame}', '{c}', 'constant', 'info', CAST(count(DISTINCT {c}) AS DOUBLE), NULL "
                        f"FROM {view} HAVING count(*) > 0 AND count(DISTINCT {c}) = 1")
            rows.append(f"SELECT '{frame}', '{c}', 'all_unique', 'info', CAST(count(DISTINCT {c}) AS DOUBLE), NULL "
                        f"FROM {view} HAVING count(*) > 0 AND count(DISTINCT {c}) <> 1 AND count(DISTINCT {c}) = count(*)")
    return "\nUNION ALL ".join(rows)


BILLING_KINDS = [("l_orderkey", "numeric"), ("l_linenumber", "numeric"), ("incident_date", "datetime"),
                 ("uptime_percent", "numeric"), ("avg_response_time", "numeric"), ("error_rate", "numeric"),
                 ("transaction_count", "numeric"), ("supplier_id", "numeric")]

DQ_REPORT_SQL = with_views(
    "SELECT * FROM (" + _dq_sql("approvals", "approvals", APPROVAL_KINDS) + "\nUNION ALL "
    + _dq_sql("cost_breakdowns", "cost_breakdowns", COST_KINDS) + "\nUNION ALL "
    + _dq_sql("users", "users", USER_KINDS) + "\nUNION ALL " + _dq_sql("scaled_totals", SCALED_SQL + " s", SCALED_KINDS) + "\nUNION ALL "
    + _dq_sql("empty_result", "(SELECT * FROM billing WHERE uptime_percent > 100) e", BILLING_KINDS) + ") r",
    "approvals", "cost_breakdowns", "users", "billing")


def dq_frames(spark, d):
    frames = [("approvals", A.approvals(spark, d)), ("cost_breakdowns", A.cost_breakdowns(spark, d)),
              ("users", A.users(spark, d)),
              ("scaled_totals", A.table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_totalprice") * 1000000).alias("scaled_total"),
                                                                   F.lit("orders").alias("source"))),
              ("empty_result", A.billing(spark, d).filter(F.col("uptime_percent") > 100))]
    out = None
    for name, df in frames:
        r = dq.dq_report(df).select(F.lit(name).alias("frame"), "*")
        out = r if out is None else out.unionByName(r)
    return out


@register("dq_report", tuple(f"DQ-{i}" for i in range(1, 10)), oracle=DQ_REPORT_SQL)
def dq_report(spark, d):
    return dq_frames(spark, d)


@register("dq_status", "DQ-10", oracle=f"""
SELECT frame, CASE WHEN max(CASE WHEN severity = 'warning' THEN 1 ELSE 0 END) = 1 THEN 'warning' ELSE 'passed' END
         AS sanity_status,
       count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos
FROM ({DQ_REPORT_SQL}) q GROUP BY frame""")
def dq_status(spark, d):
    return dq.dq_status(dq_frames(spark, d), ["frame"])


def cost_type_totals(spark, d, measure="delta_cost"):
    from covenant.operators import costs
    return costs.totals_with_all(A.cost_breakdowns(spark, d), measure)


@register("dq_costs", ("DQ-11", "DQ-12"), oracle=with_views("""
SELECT measure, cost_type, amount,
       CASE WHEN amount IS NULL OR isnan(amount) THEN 'error' ELSE 'warning' END AS severity,
       CASE WHEN amount IS NULL OR isnan(amount) THEN 'invalid_amount' ELSE 'negative_cost' END AS "check"
FROM (SELECT 'delta' AS measure, cost_type, CAST(sum(delta_cost) AS DOUBLE) AS amount FROM cost_breakdowns GROUP BY cost_type
      UNION ALL SELECT 'delta', 'all', CAST(sum(delta_cost) AS DOUBLE) FROM cost_breakdowns
      UNION ALL SELECT 'priced', cost_type, CAST(sum(CASE WHEN cost_unit <> 'units' THEN original_cost END) AS DOUBLE) FROM cost_breakdowns GROUP BY cost_type
      UNION ALL SELECT 'priced', 'all', CAST(sum(CASE WHEN cost_unit <> 'units' THEN original_cost END) AS DOUBLE) FROM cost_breakdowns) t
WHERE amount IS NULL OR isnan(amount) OR (cost_type <> 'all' AND amount < 0)""", "cost_breakdowns"))
def dq_costs(spark, d):
    """Checks of the deltas, and of amounts that count only lines with a price (units have none)."""
    priced = A.cost_breakdowns(spark, d).withColumn("priced", F.when(F.col("cost_unit") != "units", F.col("original_cost")))
    from covenant.operators import costs
    out = [dq.cost_checks(t).select(F.lit(name).alias("measure"), "*") for name, t in (
        ("delta", cost_type_totals(spark, d)), ("priced", costs.totals_with_all(priced, "priced")))]
    return out[0].unionByName(out[1])
