"""Penalty-projection queries over the billing and incident views."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenant import terms
from covenant.operators import execution as ex
from covenant.operators import penalties as pen
from covenant.plans import adapters as A
from covenant.plans.adapters import with_views
from covenant.plans.registry import register

UPTIME_CASE = ("CAST(CASE WHEN uptime_percent < 95.0 THEN 2500.0 WHEN uptime_percent < 98.0 THEN 1500.0 "
               "WHEN uptime_percent < 98.9 THEN 1000.0 WHEN uptime_percent < 99.0 THEN 500.0 ELSE 0.0 END AS DOUBLE)")
UPTIME_CASE_CONTRACT_ORDER = (
    "CAST(CASE WHEN uptime_percent < 99.0 THEN 500.0 WHEN uptime_percent < 98.9 THEN 1000.0 "
    "WHEN uptime_percent < 98.0 THEN 1500.0 WHEN uptime_percent < 95.0 THEN 2500.0 ELSE 0.0 END AS DOUBLE)")
RESPONSE_CASE = ("CAST(CASE WHEN avg_response_time > 10.0 THEN 1000.0 WHEN avg_response_time > 5.0 THEN 500.0 "
                 "WHEN avg_response_time > 2.0 THEN 200.0 ELSE 0.0 END AS DOUBLE)")


def tiered_frame(spark, d):
    b = A.billing(spark, d)
    return b.select(
        "l_orderkey", "l_linenumber", "incident_date", "uptime_percent", "avg_response_time",
        pen.uptime_tier_penalty(F.col("uptime_percent")).alias("uptime_penalty"),
        pen.response_tier_penalty(F.col("avg_response_time")).alias("response_penalty"),
    )


TIERED_SQL = f"""
SELECT l_orderkey, l_linenumber, incident_date, uptime_percent, avg_response_time,
       {UPTIME_CASE} AS uptime_penalty, {RESPONSE_CASE} AS response_penalty
FROM billing"""


@register("tiered_penalty", ("PRJ-2", "PRJ-4", "SRT-1"),
          oracle=with_views(TIERED_SQL + "\nORDER BY incident_date ASC NULLS LAST, l_orderkey, l_linenumber", "billing"))
def tiered_penalty(spark, d):
    return tiered_frame(spark, d).orderBy(F.col("incident_date").asc_nulls_last(), "l_orderkey", "l_linenumber")


@register("shadowed_tiers", "PRJ-4", oracle=with_views(f"""
SELECT count(*) FILTER (WHERE a <> b) AS rows_differing,
       CAST(sum(a) AS DOUBLE) AS contract_order_total, CAST(sum(b) AS DOUBLE) AS most_severe_total
FROM (SELECT {UPTIME_CASE_CONTRACT_ORDER} AS a, {UPTIME_CASE} AS b FROM billing) t""", "billing"))
def shadowed_tiers(spark, d):
    b = A.billing(spark, d).select(
        pen.uptime_tier_penalty(F.col("uptime_percent"), most_severe_first=False).alias("a"),
        pen.uptime_tier_penalty(F.col("uptime_percent")).alias("b"))
    return b.agg(F.count_if(F.col("a") != F.col("b")).alias("rows_differing"),
                 F.sum("a").alias("contract_order_total"), F.sum("b").alias("most_severe_total"))


@register("additive_penalty", "PRJ-5", oracle=with_views(f"""
SELECT l_orderkey, l_linenumber, ({UPTIME_CASE}) + ({RESPONSE_CASE}) AS total_penalty_additive
FROM billing""", "billing"))
def additive_penalty(spark, d):
    b = A.billing(spark, d)
    return b.select("l_orderkey", "l_linenumber",
                    (pen.uptime_tier_penalty(F.col("uptime_percent"))
                     + pen.response_tier_penalty(F.col("avg_response_time"))).alias("total_penalty_additive"))


@register("proportional_penalty", "PRJ-7", oracle=with_views("""
SELECT l_orderkey, l_linenumber,
       round(CASE WHEN uptime_percent < 99.0 THEN (100.0 - uptime_percent) * 100.0 ELSE 0.0 END, 6) AS uptime_penalty,
       round(CASE WHEN avg_response_time > 2.0 THEN (avg_response_time - 2.0) * 50.0 ELSE 0.0 END, 6) AS response_penalty,
       round(error_rate / nullif(uptime_percent - 95.0, 0), 6) AS error_ratio
FROM billing""", "billing"))
def proportional_penalty(spark, d):
    b = A.billing(spark, d)
    return b.select(
        "l_orderkey", "l_linenumber",
        F.round(pen.uptime_proportional(F.col("uptime_percent")), 6).alias("uptime_penalty"),
        F.round(pen.response_proportional(F.col("avg_response_time")), 6).alias("response_penalty"),
        F.round(F.try_divide(F.col("error_rate"), F.col("uptime_percent") - 95.0), 6).alias("error_ratio"),
    )


@register("column_vs_column", ("PRJ-8", "RUL-8"), oracle=with_views("""
SELECT incident_id, resolution_minutes, initial_response_minutes,
       CAST(CASE WHEN resolution_minutes > initial_response_minutes * 4 THEN 250.0 ELSE 0.0 END AS DOUBLE)
         AS resolution_penalty
FROM incidents""", "incidents"))
def column_vs_column(spark, d):
    i = A.incidents(spark, d)
    return i.select("incident_id", "resolution_minutes", "initial_response_minutes",
                    F.when(F.col("resolution_minutes") > F.col("initial_response_minutes") * 4, 250.0)
                     .otherwise(0.0).alias("resolution_penalty"))


@register("cast_date", "PRJ-9", oracle=with_views("""
SELECT incident_id, CAST(detected_at AS DATE) AS incident_day FROM incidents""", "incidents"))
def cast_date(spark, d):
    return A.incidents(spark, d).select("incident_id", F.to_date("detected_at").alias("incident_day"))


PASSTHROUGH_SQL = ("SELECT incident_date, l_orderkey, l_linenumber, CASE WHEN uptime_percent < 99 "
                   "THEN (100 - uptime_percent) * 100 ELSE 0 END AS penalty_monetary "
                   "FROM billing ORDER BY incident_date, l_orderkey, l_linenumber")


@register("sql_passthrough", "PRJ-1", oracle=with_views(
    PASSTHROUGH_SQL.replace("(100 - uptime_percent) * 100", "round((100 - uptime_percent) * 100, 6)"), "billing"))
def sql_passthrough(spark, d):
    res = ex.run_sql(spark, PASSTHROUGH_SQL, {"billing": A.billing(spark, d)})
    return res.withColumn("penalty_monetary", F.round("penalty_monetary", 6))


CALENDAR_SQL = ("SELECT EXTRACT(YEAR FROM incident_date) AS year, EXTRACT(MONTH FROM incident_date) AS month, EXTRACT(DAY FROM incident_date) AS day, "
                "COUNT(*) AS incidents FROM billing GROUP BY EXTRACT(YEAR FROM incident_date), EXTRACT(MONTH FROM incident_date), EXTRACT(DAY FROM incident_date)")


@register("calendar_fields", "PRJ-1", oracle=with_views(
    f"SELECT CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, CAST(day AS INTEGER) AS day, incidents FROM ({CALENDAR_SQL}) c", "billing"))
def calendar_fields(spark, d):
    """A user statement with the EXTRACT forms."""
    return ex.run_sql(spark, CALENDAR_SQL, {"billing": A.billing(spark, d)})


@register("select_all", "PRJ-3", oracle=with_views("SELECT * FROM billing", "billing"))
def select_all(spark, d):
    return ex.run_sql(spark, ex.default_query("billing"), {"billing": A.billing(spark, d)})


ROW_PEN_SQL = f"""
SELECT l_orderkey, l_linenumber, incident_date, uptime_penalty, response_penalty,
       (CASE WHEN uptime_penalty > 0 THEN uptime_penalty ELSE 0.0 END)
     + (CASE WHEN response_penalty > 0 THEN response_penalty ELSE 0.0 END) AS total_penalty
FROM ({TIERED_SQL}) t"""


def row_penalty_frame(spark, d):
    t = tiered_frame(spark, d).select("l_orderkey", "l_linenumber", "incident_date",
                                      "uptime_penalty", "response_penalty")
    return pen.with_row_penalty(t)


@register("row_penalty", "RUL-5", oracle=with_views(ROW_PEN_SQL, "billing"))
def row_penalty(spark, d):
    return row_penalty_frame(spark, d)


@register("violation_summary", "AGG-15", oracle=with_views(f"""
SELECT count(*) FILTER (WHERE total_penalty > 0) AS violating_rows,
       round(coalesce(sum(total_penalty) FILTER (WHERE total_penalty > 0), 0.0), 4) AS total_penalty,
       count(*) AS rows_analyzed
FROM ({ROW_PEN_SQL}) r""", "billing"))
def violation_summary(spark, d):
    return pen.violation_summary(row_penalty_frame(spark, d))


@register("proof_violation_rate", "AGG-16", oracle=with_views(f"""
SELECT CAST(sum((uptime_penalty > 0)::INT + (response_penalty > 0)::INT) AS BIGINT) AS violating_cells,
       round(sum(CASE WHEN uptime_penalty > 0 THEN uptime_penalty ELSE 0.0 END
               + CASE WHEN response_penalty > 0 THEN response_penalty ELSE 0.0 END), 4) AS total_penalty,
       count(*) AS rows_analyzed,
       round(sum((uptime_penalty > 0)::INT + (response_penalty > 0)::INT) / greatest(count(*), 1) * 100, 4)
         AS violation_rate_pct
FROM ({TIERED_SQL}) t""", "billing"))
def proof_violation_rate(spark, d):
    t = tiered_frame(spark, d)
    return pen.proof_violation_rate(t, ["uptime_penalty", "response_penalty"])


LABELS_SQL = f"""
SELECT l_orderkey, l_linenumber, incident_date, total_penalty,
       CASE WHEN concat_ws(', ', CASE WHEN uptime_penalty > 0 THEN 'Uptime SLA' END,
                               CASE WHEN response_penalty > 0 THEN 'Response Time SLA' END) = ''
            THEN 'No violations'
            ELSE concat_ws(', ', CASE WHEN uptime_penalty > 0 THEN 'Uptime SLA' END,
                                 CASE WHEN response_penalty > 0 THEN 'Response Time SLA' END) END AS violated_rules,
       CASE WHEN total_penalty > 0 THEN 'VIOLATION' ELSE 'Compliant' END AS status
FROM ({ROW_PEN_SQL}) r"""


@register("rule_labels", "RUL-6", oracle=with_views(LABELS_SQL, "billing"))
def rule_labels(spark, d):
    r = pen.with_rule_labels(row_penalty_frame(spark, d), ["uptime_penalty", "response_penalty"])
    return r.select("l_orderkey", "l_linenumber", "incident_date", "total_penalty", "violated_rules", "status")


@register("incident_report", "AUD-10", oracle=with_views(f"""
SELECT CAST(incident_date AS VARCHAR) AS "Date", violated_rules AS "Violated Rules",
       CASE WHEN total_penalty > 0 THEN '$' || format('{{:,.2f}}', total_penalty) ELSE '$0' END AS "Penalty",
       status AS "Status", l_orderkey, l_linenumber
FROM ({LABELS_SQL}) x""", "billing"))
def incident_report(spark, d):
    r = rule_labels(spark, d)
    return r.select(
        F.col("incident_date").cast("string").alias("Date"),
        F.col("violated_rules").alias("Violated Rules"),
        F.when(F.col("total_penalty") > 0, F.concat(F.lit("$"), F.format_number("total_penalty", 2)))
         .otherwise(F.lit("$0")).alias("Penalty"),
        F.col("status").alias("Status"), "l_orderkey", "l_linenumber")


@register("pct_penalty", ("RUL-3", "PRJ-6"), oracle=with_views(f"""
SELECT l_orderkey, l_linenumber,
       CAST(CASE WHEN uptime_percent < 95.0 THEN 25.0 WHEN uptime_percent < 98.0 THEN 15.0
            WHEN uptime_percent < 98.9 THEN 10.0 WHEN uptime_percent < 99.0 THEN 5.0 ELSE 0.0 END AS DOUBLE)
         AS uptime_credit_pct,
       CAST(CASE WHEN avg_response_time > 10.0 THEN 10.0 WHEN avg_response_time > 5.0 THEN 5.0
            WHEN avg_response_time > 2.0 THEN 2.0 ELSE 0.0 END AS DOUBLE) AS response_credit_pct,
       uptime_credit_pct / 100 * {terms.MONTHLY_SERVICE_FEE} AS uptime_penalty,
       response_credit_pct / 100 * {terms.MONTHLY_SERVICE_FEE} AS response_penalty
FROM billing""", "billing"))
def pct_penalty(spark, d):
    b = A.billing(spark, d)
    up = pen.tiered_pct(F.col("uptime_percent"), terms.UPTIME_TIERS, "<")
    rt = pen.tiered_pct(F.col("avg_response_time"), terms.RESPONSE_TIERS, ">")
    return b.select("l_orderkey", "l_linenumber", up.alias("uptime_credit_pct"), rt.alias("response_credit_pct"),
                    pen.pct_of_fee(up).alias("uptime_penalty"), pen.pct_of_fee(rt).alias("response_penalty"))
