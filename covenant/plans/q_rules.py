"""Rule evaluation, caps, allowances and incident-window queries
(RUL-*, JN-7, WIN-*, AGG-20, LIM-2/4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenant import terms
from covenant.operators import intervals as iv
from covenant.operators import joins as jn
from covenant.operators import rules as ru
from covenant.operators import windows as wn
from covenant.plans import adapters as A
from covenant.plans.adapters import with_views
from covenant.plans.registry import register
from covenant.session import written

RULE_STRUCT_SQL = ("STRUCT(rule_id VARCHAR, metric VARCHAR, threshold DOUBLE, threshold_operator VARCHAR, "
                   "penalty_amount DOUBLE, penalty_type VARCHAR, penalty_percentage DOUBLE, description VARCHAR, "
                   "applicable_period VARCHAR)[]")
RULES_CTE = f"""
SELECT contract_id, r.rule_id, r.metric, r.threshold, r.threshold_operator, r.penalty_amount, r.penalty_type,
       r.penalty_percentage, r.description, r.applicable_period
FROM (SELECT contract_id, unnest(CAST(json_extract(content, '$.sla_rules') AS {RULE_STRUCT_SQL})) AS r
      FROM rule_responses) x"""
TERMS_CTE = """
SELECT contract_id, CAST(json_extract(content, '$.monthly_service_fee') AS DOUBLE) AS monthly_fee,
       CAST(json_extract(content, '$.max_monthly_penalty_percentage') AS DOUBLE) AS max_penalty_pct,
       CAST(json_extract(content, '$.monthly_service_fee') AS DOUBLE)
         * CAST(json_extract(content, '$.max_monthly_penalty_percentage') AS DOUBLE) / 100 AS monthly_cap
FROM rule_responses"""
METRICS = ["uptime_percent", "avg_response_time", "error_rate"]
LINE_KEY = list(A.LINE_KEY)
MEAS_CTE = "\nUNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, transaction_count, supplier_id, contract_id, incident_date, "
    f"'{m}' AS metric, CAST({m} AS DOUBLE) AS value "
    f"FROM billing_contracts" for m in METRICS)
MATCH_SQL = ("CASE r.threshold_operator WHEN '<' THEN m.value < r.threshold WHEN '<=' THEN m.value <= r.threshold "
             "WHEN '>' THEN m.value > r.threshold WHEN '>=' THEN m.value >= r.threshold "
             "WHEN '=' THEN m.value = r.threshold WHEN '==' THEN m.value = r.threshold "
             "WHEN '!=' THEN m.value <> r.threshold WHEN '<>' THEN m.value <> r.threshold ELSE FALSE END")
EVAL_CTE = f"""
SELECT l_orderkey, l_linenumber, transaction_count, supplier_id, contract_id, incident_date, metric, value,
       rule_id, penalty_percentage, penalty_amount, penalty
FROM (SELECT m.*, r.rule_id, r.penalty_percentage, r.penalty_amount,
             CAST(r.penalty_percentage * t.monthly_fee / 100 AS DECIMAL(18,4)) AS penalty,
             row_number() OVER (PARTITION BY m.l_orderkey, m.l_linenumber, m.transaction_count, m.supplier_id, m.metric
                                ORDER BY r.penalty_percentage DESC, r.rule_id) AS rn
      FROM meas m JOIN rules r ON r.contract_id = m.contract_id AND r.metric = m.metric AND {MATCH_SQL}
      JOIN terms t ON t.contract_id = m.contract_id) z
WHERE rn = 1"""
RULE_CTES = {"rules": RULES_CTE, "terms": TERMS_CTE, "meas": MEAS_CTE, "violations": EVAL_CTE}


def _rules(spark, d):
    return ru.explode_rules(A.rule_responses(spark, d), ["contract_id"])


def violations(spark, d):
    """Most severe matching rule per (billing row, metric), priced by the
    contract's fee as an exact decimal."""
    bc = A.billing_contracts(spark, d)
    meas = ru.measurements(bc, LINE_KEY + ["contract_id"], METRICS, extra=["incident_date"])
    ev = ru.evaluate(meas, _rules(spark, d), ["contract_id"])
    # one row per contract: the planner broadcasts it from its scan size
    t = ru.contract_terms(A.rule_responses(spark, d), ["contract_id"])
    return (ev.join(t, "contract_id", "inner")
            .withColumn("penalty", (F.col("penalty_percentage") * F.col("monthly_fee") / 100).cast("decimal(18,4)"))
            .select(*LINE_KEY, "contract_id", "incident_date", "metric", "value", "rule_id",
                    "penalty_percentage", "penalty_amount", "penalty", "monthly_cap"))


@register("rules_explode", "RUL-1", oracle=with_views("SELECT * FROM rules", "rule_responses",
                                                      extra={"rules": RULES_CTE}))
def rules_explode(spark, d):
    return _rules(spark, d)


@register("conditions_explode", "RUL-12", oracle=with_views("""
SELECT contract_id, CAST(pos - 1 AS INTEGER) AS position, c.metric, c.condition, c.penalty_rule
FROM (SELECT contract_id,
             unnest(CAST(json_extract(content, '$.violation_conditions')
                         AS STRUCT(metric VARCHAR, condition VARCHAR, penalty_rule VARCHAR)[])) AS c,
             unnest(range(1, CAST(json_array_length(json_extract(content, '$.violation_conditions')) AS BIGINT) + 1)) AS pos
      FROM rule_responses) x""", "rule_responses"))
def conditions_explode(spark, d):
    return ru.explode_conditions(A.rule_responses(spark, d), ["contract_id"])


@register("rule_eval", ("JN-7", "RUL-2"), oracle=with_views(
    "SELECT l_orderkey, l_linenumber, transaction_count, supplier_id, contract_id, incident_date, metric, value, "
    "rule_id, penalty_percentage, penalty_amount, CAST(penalty AS DOUBLE) AS penalty FROM violations",
    "rule_responses", "billing_contracts", extra=RULE_CTES))
def rule_eval(spark, d):
    return violations(spark, d).drop("monthly_cap").withColumn("penalty", F.col("penalty").cast("double"))


@register("topk_violations", "LIM-4", oracle=with_views(
    "SELECT l_orderkey, l_linenumber, transaction_count, supplier_id, metric, rule_id, "
    "CAST(penalty AS DOUBLE) AS penalty FROM violations "
    "ORDER BY penalty DESC, l_orderkey, l_linenumber, transaction_count, supplier_id, metric LIMIT 10",
    "rule_responses", "billing_contracts", extra=RULE_CTES))
def topk_violations(spark, d):
    v = violations(spark, d)
    return (v.orderBy(F.col("penalty").desc(), *LINE_KEY, "metric").limit(10)
            .select(*LINE_KEY, "metric", "rule_id", F.col("penalty").cast("double").alias("penalty")))


@register("monthly_cap", ("RUL-4", "RUL-3"), oracle=with_views("""
SELECT v.contract_id, CAST(date_trunc('month', incident_date) AS DATE) AS month, count(*) AS violations,
       CAST(sum(penalty) AS DOUBLE) AS raw_total,
       least(CAST(sum(penalty) AS DOUBLE), max(t.monthly_cap)) AS capped_total
FROM violations v JOIN terms t ON t.contract_id = v.contract_id
GROUP BY v.contract_id, CAST(date_trunc('month', incident_date) AS DATE)""",
    "rule_responses", "billing_contracts", extra=RULE_CTES))
def monthly_cap(spark, d):
    v = violations(spark, d).withColumn("month", F.trunc("incident_date", "MM"))
    return ru.monthly_totals(v, ["contract_id", "month"], "penalty", F.col("monthly_cap"))


@register("capped_credits", "WIN-2", oracle=with_views("""
SELECT l_orderkey, l_linenumber, transaction_count, supplier_id, metric, contract_id, month,
       CAST(penalty AS DOUBLE) AS penalty,
       CAST(prior_sum AS DOUBLE) AS prior_sum,
       greatest(0.0, least(CAST(penalty AS DOUBLE), cap - CAST(prior_sum AS DOUBLE))) AS credit
FROM (SELECT v.*, CAST(date_trunc('month', incident_date) AS DATE) AS month, t.monthly_cap AS cap,
             coalesce(sum(penalty) OVER (PARTITION BY v.contract_id, date_trunc('month', incident_date)
                                         ORDER BY incident_date, l_orderkey, l_linenumber, transaction_count,
                                                  supplier_id, metric
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_sum
      FROM violations v JOIN terms t ON t.contract_id = v.contract_id) x""",
    "rule_responses", "billing_contracts", extra=RULE_CTES))
def capped_credits(spark, d):
    # evaluated once: the running sums read the rows twice, for themselves and for the chunks' offsets
    v = written(violations(spark, d).withColumn("month", F.trunc("incident_date", "MM")), "violations")
    # chunk = (day, block of 2^20 order keys): monotone in the sort order and
    # fine enough that a hot contract-month is spread over many tasks
    r = wn.capped_in_order(v, ["contract_id", "month"], ["incident_date", *LINE_KEY, "metric"], "penalty", F.col("monthly_cap"),
                           chunk=F.struct("incident_date", F.shiftright("l_orderkey", 20).alias("blk")))
    return r.select(*LINE_KEY, "metric", "contract_id", "month", *[F.col(c).cast("double").alias(c) for c in ("penalty", "prior_sum", "credit")])


@register("monthly_attainment", "AGG-20", oracle=with_views("""
SELECT p.contract_id, CAST(p.month AS DATE) AS month, coalesce(a.n, 0) AS measurements, round(a.avg_uptime, 6) AS average,
       CASE WHEN a.avg_uptime IS NOT NULL THEN coalesce(max(r.penalty_percentage), 0.0) END AS credit_pct
FROM (SELECT contract_id, unnest(generate_series(first_month, last_month, INTERVAL 1 MONTH)) AS month FROM contract_periods) p
LEFT JOIN (SELECT contract_id, date_trunc('month', incident_date) AS month, count(uptime_percent) AS n,
                  CAST(sum(CAST(uptime_percent AS DECIMAL(38,10))) AS DOUBLE) / count(uptime_percent) AS avg_uptime
           FROM billing_contracts GROUP BY ALL) a ON a.contract_id = p.contract_id AND a.month = p.month
LEFT JOIN rules r ON r.contract_id = p.contract_id AND r.metric = 'uptime_percent' AND CASE r.threshold_operator
     WHEN '<' THEN a.avg_uptime < r.threshold WHEN '<=' THEN a.avg_uptime <= r.threshold WHEN '>' THEN a.avg_uptime > r.threshold
     WHEN '>=' THEN a.avg_uptime >= r.threshold ELSE FALSE END
GROUP BY p.contract_id, p.month, a.n, a.avg_uptime""", "billing_contracts", "rule_responses", "contract_periods", extra={"rules": RULES_CTE}))
def monthly_attainment(spark, d):
    """Every month of every contract, with the credit of the contract's own uptime rules."""
    out = ru.monthly_attainment(A.billing_contracts(spark, d), _rules(spark, d), A.contract_periods(spark, d), ["contract_id"],
                                "incident_date", "uptime_percent", "uptime_percent")
    return out.select("contract_id", "month", "measurements", F.round("average", 6).alias("average"), "credit_pct")


# ------------------------------------------------------------------ incidents
LIMITS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', {a}, {b})" for s, a, b in terms.SEVERITY_LIMITS) + ") l(severity, response_limit, resolution_limit)"


def limits_frame(spark):
    # fixed 4-row table: a proven-small broadcast side
    return F.broadcast(spark.createDataFrame(terms.SEVERITY_LIMITS, "severity string, response_limit int, "
                                                                    "resolution_limit int"))


def incident_breaches(spark, d):
    i = A.incidents(spark, d).join(limits_frame(spark), "severity", "left")
    return (i.withColumn("response_breach", F.col("initial_response_minutes") > F.col("response_limit"))
             .withColumn("resolution_breach", F.col("resolution_minutes") > F.col("resolution_limit")))


BREACH_CTE = f"""
SELECT i.*, l.response_limit, l.resolution_limit,
       i.initial_response_minutes > l.response_limit AS response_breach,
       i.resolution_minutes > l.resolution_limit AS resolution_breach
FROM incidents i LEFT JOIN ({LIMITS_SQL}) l ON l.severity = i.severity"""


OWN_LIMITS = [*[(None, *x) for x in terms.SEVERITY_LIMITS], *terms.SERVICE_LIMITS]
_sql_value = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
OWN_LIMITS_SQL = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql_value, r)) + ")" for r in OWN_LIMITS) \
    + ") l(service, severity, response_limit, resolution_limit)"


def _limit_sql(value):
    """The first stated value from (service, severity) over severity and service to the default."""
    pick = lambda cond: f"(SELECT min({value}) FROM limits l WHERE {cond})"
    return (f"coalesce({pick('l.service = i.service AND l.severity = i.severity')}, {pick('l.service IS NULL AND l.severity = i.severity')}, "
            f"{pick('l.service = i.service AND l.severity IS NULL')}, {pick('l.service IS NULL AND l.severity IS NULL')})")


@register("severity_limits", "RUL-7", oracle=with_views(f"""
SELECT incident_id, service, severity, response_limit, resolution_limit, initial_response_minutes > response_limit AS response_breach,
       resolution_minutes > resolution_limit AS resolution_breach
FROM (SELECT i.*, {_limit_sql("response_limit")} AS response_limit, {_limit_sql("resolution_limit")} AS resolution_limit FROM incidents i) x""",
    "incidents", extra={"limits": OWN_LIMITS_SQL}))
def severity_limits(spark, d):
    """Limits of (service, severity), of the severity, of the service, or the default, in this order and value by value."""
    limits = spark.createDataFrame(OWN_LIMITS, "service string, severity string, response_limit int, resolution_limit int")
    i = ru.with_limits(A.incidents(spark, d), limits, ["service", "severity"], ["response_limit", "resolution_limit"])
    return i.select("incident_id", "service", "severity", "response_limit", "resolution_limit",
                    (F.col("initial_response_minutes") > F.col("response_limit")).alias("response_breach"),
                    (F.col("resolution_minutes") > F.col("resolution_limit")).alias("resolution_breach"))


@register("breach_confusion", "RUL-10", oracle=with_views("""
SELECT sla_breached AS labelled, (response_breach OR resolution_breach) AS predicted, count(*) AS incidents
FROM breaches GROUP BY ALL""", "incidents", extra={"breaches": BREACH_CTE}))
def breach_confusion(spark, d):
    b = incident_breaches(spark, d)
    return b.groupBy(F.col("sla_breached").alias("labelled"),
                     (F.col("response_breach") | F.col("resolution_breach")).alias("predicted")) \
            .agg(F.count(F.lit(1)).alias("incidents"))


@register("monthly_allowance", "WIN-1", oracle=with_views(f"""
SELECT incident_id, service, month, rn > {terms.MONTHLY_BREACH_ALLOWANCE} AS breach_counted
FROM (SELECT incident_id, service, CAST(date_trunc('month', detected_at) AS DATE) AS month,
             row_number() OVER (PARTITION BY service, date_trunc('month', detected_at)
                                ORDER BY detected_at, incident_id) AS rn
      FROM breaches WHERE resolution_breach) x""", "incidents", extra={"breaches": BREACH_CTE}))
def monthly_allowance(spark, d):
    b = incident_breaches(spark, d).filter("resolution_breach").withColumn("month", F.trunc("detected_at", "MM"))
    f = wn.flag_first_k(b, ["service", "month"], ["detected_at", "incident_id"], terms.MONTHLY_BREACH_ALLOWANCE,
                        ["incident_id"])
    return f.select("incident_id", "service", "month", (~F.col("within_allowance")).alias("breach_counted"))


@register("rolling_hour", "WIN-4", oracle=with_views("""
SELECT incident_id, service,
       count(*) OVER (PARTITION BY service ORDER BY detected_at
                      RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS events_in_window
FROM incidents""", "incidents"))
def rolling_hour(spark, d):
    i = A.incidents(spark, d).select("incident_id", "service", "detected_at")
    return wn.rolling_count(i, ["service"], "detected_at", 3600).select("incident_id", "service", "events_in_window")


NOTICE = terms.EXCLUSION_NOTICE_HOURS


def exclusion_windows(spark, d):
    """Maintenance announced early enough to exclude incidents of its service."""
    w = A.maintenance_windows(spark, d)
    enough = F.lit(False)
    for kind, hours in NOTICE.items():
        enough = enough | ((F.col("kind") == kind) & (F.col("notice_hours") >= hours))
    return w.where(enough)


NOTICED_CTE = "SELECT * FROM maintenance_windows WHERE " + " OR ".join(
    f"(kind = '{k}' AND notice_hours >= {h})" for k, h in NOTICE.items())
MERGED_CTE = """
SELECT service, min(window_start) AS window_start, max(window_end) AS window_end
FROM (SELECT *, sum(new) OVER (PARTITION BY service ORDER BY window_start, window_id) AS island
      FROM (SELECT *, CASE WHEN window_start <= max(window_end) OVER (PARTITION BY service ORDER BY window_start, window_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM noticed) a) b
GROUP BY service, island"""
NET_CTE = """
SELECT i.incident_id, i.service, i.severity, i.sla_breached, i.detected_at, i.resolved_at, i.resolution_minutes,
       coalesce(bool_or(i.detected_at BETWEEN m.window_start AND m.window_end), FALSE) AS excluded,
       coalesce(sum(CASE WHEN m.window_start IS NOT NULL THEN date_diff('microsecond', greatest(i.detected_at, m.window_start),
                                                                        least(i.resolved_at, m.window_end)) END), 0) AS micros
FROM incidents i LEFT JOIN merged m ON m.service = i.service AND m.window_start <= i.resolved_at AND m.window_end >= i.detected_at
GROUP BY ALL"""
EXCLUSION_CTES = {"noticed": NOTICED_CTE, "merged": MERGED_CTE, "net": NET_CTE}


@register("exclusion_windows", "RUL-11", oracle=with_views(
    "SELECT service, window_start, window_end, date_diff('microsecond', window_start, window_end) / 60000000.0 AS minutes FROM merged",
    "maintenance_windows", extra={"noticed": NOTICED_CTE, "merged": MERGED_CTE}))
def merged_exclusion_windows(spark, d):
    m = iv.merge_windows(exclusion_windows(spark, d), "window_start", "window_end", ["service"])
    return m.select("service", "window_start", "window_end",
                    ((jn.micros(F.col("window_end")) - jn.micros(F.col("window_start"))) / 60000000.0).alias("minutes"))


@register("exclusions", "RUL-11", oracle=with_views(
    "SELECT incident_id, service, resolution_minutes FROM net WHERE NOT excluded",
    "incidents", "maintenance_windows", extra=EXCLUSION_CTES))
def exclusions(spark, d):
    """Incidents that do not begin inside an exclusion window of their service."""
    i = A.incidents(spark, d).select("incident_id", "service", "resolution_minutes", "detected_at")
    kept = iv.point_in_interval(i, "detected_at", exclusion_windows(spark, d), "window_start", "window_end", on=["service"])
    return kept.select("incident_id", "service", "resolution_minutes")


@register("net_breach_minutes", "RUL-11", oracle=with_views(f"""
SELECT incident_id, service, n.severity, excluded, micros / 60000000.0 AS excluded_minutes,
       resolution_minutes - micros / 60000000.0 AS net_minutes,
       resolution_minutes > l.resolution_limit AS gross_breach,
       NOT excluded AND resolution_minutes - micros / 60000000.0 > l.resolution_limit AS net_breach
FROM net n LEFT JOIN ({LIMITS_SQL}) l ON l.severity = n.severity""", "incidents", "maintenance_windows", extra=EXCLUSION_CTES))
def net_breach_minutes(spark, d):
    """Resolution time less the part inside exclusion windows, and the breaches that remain."""
    i = A.incidents(spark, d).select("incident_id", "service", "severity", "detected_at", "resolved_at", "resolution_minutes")
    x = iv.subtract_windows(i, "detected_at", "resolved_at", exclusion_windows(spark, d), "window_start", "window_end", on=["service"])
    gone = F.col("excluded_micros") / 60000000.0
    net = F.col("resolution_minutes") - gone
    return (x.join(limits_frame(spark), "severity", "left")
            .select("incident_id", "service", "severity", F.col("starts_inside").alias("excluded"), gone.alias("excluded_minutes"), net.alias("net_minutes"),
                    (F.col("resolution_minutes") > F.col("resolution_limit")).alias("gross_breach"),
                    (~F.col("starts_inside") & (net > F.col("resolution_limit"))).alias("net_breach")))


SPAN_CTE = """
SELECT l_orderkey, l_linenumber, l_shipdate AS span_start,
       l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS span_end FROM lineitem"""


@register("month_split", "RUL-9", oracle=with_views("""
SELECT l_orderkey, l_linenumber, CAST(month AS DATE) AS month,
       date_sub('minute', greatest(span_start, month), least(span_end, month + INTERVAL 1 MONTH)) AS overlap_minutes
FROM (SELECT *, unnest(generate_series(date_trunc('month', span_start), date_trunc('month', span_end),
                                       INTERVAL 1 MONTH)) AS month FROM spans) s""", extra={"spans": SPAN_CTE}))
def month_split(spark, d):
    li = A.table(spark, d, "lineitem")
    spans = li.select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("span_start"),
                      F.timestamp_add("DAY", F.col("l_quantity").cast("int"), F.col("l_shipdate")).alias("span_end"))
    return ru.split_by_month(spans, "span_start", "span_end").select("l_orderkey", "l_linenumber", "month",
                                                                    "overlap_minutes")


@register("group_preview", "LIM-2", oracle=with_views("""
SELECT month, rank, l_orderkey, l_linenumber, transaction_count, supplier_id FROM (
  SELECT CAST(date_trunc('month', incident_date) AS DATE) AS month, l_orderkey, l_linenumber, transaction_count,
         supplier_id,
         row_number() OVER (PARTITION BY date_trunc('month', incident_date)
                            ORDER BY incident_date, l_orderkey, l_linenumber, transaction_count, supplier_id) AS rank
  FROM billing) x WHERE rank <= 20""", "billing"))
def group_preview(spark, d):
    b = A.billing(spark, d).withColumn("month", F.trunc("incident_date", "MM"))
    t = wn.top_k_per_group(b, ["month"], ["incident_date", *LINE_KEY], 20, LINE_KEY)
    return t.select("month", F.col("rank").cast("bigint").alias("rank"), *LINE_KEY)
