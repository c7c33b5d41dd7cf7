"""Domain views over the driver's test tables.

Each view exists twice: as a DataFrame builder (what the library runs) and as
an SQL body (what the DuckDB oracle runs). Both must compute the same values,
so every expression is written in an order both engines evaluate identically
(plain IEEE double arithmetic, exact decimals for money).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table feeding per-row text parsing (JSON, regex, casts): spread
    over the cluster's cores when it arrives in fewer splits (no-op for
    multi-file inputs)."""
    from covenant.sources.files import spread
    return spread(table(spark, sf_dir, name))


# ---------------------------------------------------------------- billing
# (l_orderkey, l_linenumber) repeats in the test tables; with part and
# supplier the line is unique, so windows get a total order.
LINE_KEY = ("l_orderkey", "l_linenumber", "transaction_count", "supplier_id")

def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.to_date("l_shipdate").alias("incident_date"),
        (F.lit(100.0) - F.col("l_tax") * 50 - F.col("l_discount") * 21).alias("uptime_percent"),
        (F.col("l_quantity") / 4).alias("avg_response_time"),
        (F.col("l_discount") * 5).alias("error_rate"),
        F.col("l_partkey").alias("transaction_count"),
        F.col("l_suppkey").alias("supplier_id"),
    )


BILLING_SQL = """
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS incident_date,
       100.0 - l_tax * 50 - l_discount * 21 AS uptime_percent,
       l_quantity / 4 AS avg_response_time,
       l_discount * 5 AS error_rate,
       l_partkey AS transaction_count,
       l_suppkey AS supplier_id
FROM lineitem"""


# ---------------------------------------------------------------- incidents
def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    res_min = F.ceil("value").cast("bigint")
    return ev.select(
        F.col("event_id").alias("incident_id"),
        F.col("event_type").alias("service"),
        F.when(F.col("value") >= 400, "critical").when(F.col("value") >= 200, "high")
         .when(F.col("value") >= 50, "medium").otherwise("low").alias("severity"),
        F.col("ts").alias("detected_at"),
        F.get_json_object("props", "$.k").cast("int").alias("initial_response_minutes"),
        res_min.alias("resolution_minutes"),
        F.timestamp_add("MINUTE", res_min, F.col("ts")).alias("resolved_at"),
        F.col("value").alias("impact_value"),
        (F.col("event_type") == "error").alias("sla_breached"),
        F.col("user_id").alias("tenant_id"),
    )


INCIDENTS_SQL = """
SELECT event_id AS incident_id, event_type AS service,
       CASE WHEN value >= 400 THEN 'critical' WHEN value >= 200 THEN 'high'
            WHEN value >= 50 THEN 'medium' ELSE 'low' END AS severity,
       ts AS detected_at,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS initial_response_minutes,
       CAST(ceil(value) AS BIGINT) AS resolution_minutes,
       ts + to_minutes(CAST(ceil(value) AS BIGINT)) AS resolved_at,
       value AS impact_value,
       (event_type = 'error') AS sla_breached,
       user_id AS tenant_id
FROM events"""


# ---------------------------------------------------------------- costs
def cost_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cost line per lineitem; money as exact decimals."""
    li = table(spark, sf_dir, "lineitem")
    orig = F.col("l_extendedprice").cast("decimal(18,2)")
    calc = orig * (F.lit(1).cast("decimal(18,2)") - F.col("l_discount").cast("decimal(18,2)"))
    return li.select(
        "l_orderkey", "l_linenumber",
        F.col("l_orderkey").alias("calculation_id"),
        F.when(F.col("l_returnflag") == "A", "monetary")
         .when(F.col("l_returnflag") == "N", "credits").otherwise("units").alias("cost_type"),
        F.when(F.col("l_linestatus") == "O", "USD").alias("cost_currency"),
        orig.alias("original_cost"),
        calc.cast("decimal(18,4)").alias("calculated_cost"),
        (calc - orig).cast("decimal(18,4)").alias("delta_cost"),
        F.trunc(F.to_date("l_shipdate"), "MM").alias("period_start"),
        F.last_day(F.to_date("l_shipdate")).alias("period_end"),
        F.when(F.col("l_returnflag") == "R", "units").otherwise("money").alias("cost_unit"),
        F.when(F.col("l_linenumber") > 1, F.concat(F.lit('{"line": '), F.col("l_linenumber").cast("string"), F.lit("}"))).alias("cost_details"),
    )


COST_BREAKDOWNS_SQL = """
SELECT l_orderkey, l_linenumber, l_orderkey AS calculation_id,
       CASE WHEN l_returnflag = 'A' THEN 'monetary' WHEN l_returnflag = 'N' THEN 'credits'
            ELSE 'units' END AS cost_type,
       CASE WHEN l_linestatus = 'O' THEN 'USD' END AS cost_currency,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS original_cost,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(18,2)) - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(18,4)) AS calculated_cost,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(18,2)) - CAST(l_discount AS DECIMAL(18,2))) - CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS delta_cost,
       CAST(date_trunc('month', l_shipdate) AS DATE) AS period_start,
       last_day(CAST(l_shipdate AS DATE)) AS period_end,
       CASE WHEN l_returnflag = 'R' THEN 'units' ELSE 'money' END AS cost_unit,
       CASE WHEN l_linenumber > 1 THEN '{"line": ' || CAST(l_linenumber AS VARCHAR) || '}' END AS cost_details
FROM lineitem"""


# ---------------------------------------------------------------- ledger
def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", "")), F.lit("@example.com")).alias("email"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "admin")
         .when(F.col("c_mktsegment") == "BUILDING", "approver").otherwise("analyst").alias("role"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


USERS_SQL = """
SELECT c_custkey AS id, c_name AS username,
       lower(replace(c_name, '#', '')) || '@example.com' AS email,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin'
            WHEN c_mktsegment = 'BUILDING' THEN 'approver' ELSE 'analyst' END AS role,
       (c_acctbal >= 0) AS is_active
FROM customer"""


def ledger_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract documents: one per nation (small dimension)."""
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").alias("id"),
        F.concat(F.lower("n_name"), F.lit("_contract.txt")).alias("filename"),
        F.when(F.col("n_regionkey") == 0, "sla").when(F.col("n_regionkey") == 1, "SLA")
         .when(F.col("n_regionkey") == 2, "insurance")
         .when(F.col("n_regionkey") == 3, "service_agreement").otherwise("lease").alias("document_type"),
        F.col("n_regionkey").alias("uploaded_by"),
        F.when(F.col("n_nationkey") % 4 == 0, "parsed").when(F.col("n_nationkey") % 4 == 1, "complete")
         .when(F.col("n_nationkey") % 4 == 2, "error").otherwise("pending").alias("status"),
        F.timestamp_add("DAY", F.col("n_nationkey").cast("int"), F.lit("1992-01-01 08:30:00").cast("timestamp_ntz")).alias("upload_date"),
    )


LEDGER_DOCUMENTS_SQL = """
SELECT n_nationkey AS id, lower(n_name) || '_contract.txt' AS filename,
       CASE WHEN n_regionkey = 0 THEN 'sla' WHEN n_regionkey = 1 THEN 'SLA'
            WHEN n_regionkey = 2 THEN 'insurance' WHEN n_regionkey = 3 THEN 'service_agreement'
            ELSE 'lease' END AS document_type,
       n_regionkey AS uploaded_by,
       CASE n_nationkey % 4 WHEN 0 THEN 'parsed' WHEN 1 THEN 'complete' WHEN 2 THEN 'error' ELSE 'pending' END AS status, TIMESTAMP '1992-01-01 08:30:00' + to_days(CAST(n_nationkey AS INTEGER)) AS upload_date
FROM nation"""


def ledger_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted queries: one per customer, pointing at its nation's contract."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("document_id"),
        F.concat(F.lit("SELECT * FROM billing WHERE transaction_count > "),
                 F.col("c_custkey").cast("string")).alias("query_text"),
        F.lit(0.85).alias("extraction_confidence"),
        F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit('{"min_transactions": '), F.col("c_custkey").cast("string"), F.lit("}")))
         .alias("extracted_terms"),
        F.when(F.col("c_acctbal") < 0, "invalid")
         .when(F.col("c_mktsegment") == "HOUSEHOLD", "pending").otherwise("valid").alias("validation_status"),
    )


LEDGER_QUERIES_SQL = """
SELECT c_custkey AS id, c_nationkey AS document_id,
       'SELECT * FROM billing WHERE transaction_count > ' || CAST(c_custkey AS VARCHAR) AS query_text,
       CAST(0.85 AS DOUBLE) AS extraction_confidence,
       CASE WHEN c_custkey % 5 > 0 THEN '{"min_transactions": ' || CAST(c_custkey AS VARCHAR) || '}' END AS extracted_terms,
       CASE WHEN c_acctbal < 0 THEN 'invalid' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'pending'
            ELSE 'valid' END AS validation_status
FROM customer"""


def calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calculation runs: one per order, run against its customer's query."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("query_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "error").otherwise("success").alias("execution_status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "warning")
         .when(F.col("o_orderpriority") == "5-LOW", "failed").otherwise("passed").alias("sanity_check_status"),
        F.col("o_totalprice").alias("result_value"),
        F.col("o_orderdate").alias("executed_at"),
        (F.col("o_orderkey") % 31).alias("result_rows_count"),
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("o_orderkey") % 31), lambda i: F.concat_ws(
            ":", F.col("o_orderpriority"), i.cast("string"))).alias("result_data"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("high value, clerk "), F.col("o_custkey").cast("string")))
         .alias("sanity_check_details"),
    )


CALCULATIONS_SQL = """
SELECT o_orderkey AS id, o_custkey AS query_id,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'error' ELSE 'success' END AS execution_status,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'warning' WHEN o_orderpriority = '5-LOW' THEN 'failed'
            ELSE 'passed' END AS sanity_check_status,
       o_totalprice AS result_value,
       o_orderdate AS executed_at, o_orderkey % 31 AS result_rows_count,
       [o_orderpriority || ':' || CAST(i AS VARCHAR) FOR i IN range(0, o_orderkey % 31 + 1)] AS result_data,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'high value, clerk ' || CAST(o_custkey AS VARCHAR) END AS sanity_check_details
FROM orders"""


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval per calculation: F approved, O pending, P rejected."""
    o = table(spark, sf_dir, "orders")
    status = (F.when(F.col("o_orderstatus") == "F", "approved")
              .when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("calculation_id"),
        status.alias("request_status"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_custkey")).alias("approved_by"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("approval_date"),
        (F.col("o_orderpriority") == "1-URGENT").alias("requires_escalation"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("checked \""), F.col("o_orderpriority"), F.lit("\""))).alias("approver_comments"),
    )


APPROVALS_SQL = """
SELECT o_orderkey AS id, o_orderkey AS calculation_id,
       CASE WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderstatus = 'O' THEN 'pending'
            ELSE 'rejected' END AS request_status,
       CASE WHEN o_orderstatus <> 'O' THEN o_custkey END AS approved_by,
       CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS approval_date,
       (o_orderpriority = '1-URGENT') AS requires_escalation,
       CASE WHEN o_orderkey % 3 = 0 THEN 'checked "' || o_orderpriority || '"' END AS approver_comments
FROM orders"""


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval decisions over time, one event per decision; entity = user_id."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("decision_id"),
        F.col("user_id").alias("calculation_id"),
        F.when(F.col("event_type") == "view", "hold")
         .when(F.col("event_type").isin("click", "purchase"), "approve")
         .when(F.col("event_type") == "signup", "reject").otherwise("escalate").alias("decision"),
        F.col("ts").alias("decided_at"),
    )


DECISION_LOG_SQL = """
SELECT event_id AS decision_id, user_id AS calculation_id,
       CASE WHEN event_type = 'view' THEN 'hold'
            WHEN event_type IN ('click', 'purchase') THEN 'approve'
            WHEN event_type = 'signup' THEN 'reject' ELSE 'escalate' END AS decision,
       ts AS decided_at
FROM events"""


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        F.col("event_type").alias("action"),
        F.when(F.col("event_type").isin("view", "click"), "document")
         .when(F.col("event_type") == "purchase", "calculation").otherwise("approval").alias("entity_type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("entity_id"),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("result_status"),
        F.col("ts").alias("timestamp"),
    )


AUDIT_LOGS_SQL = """
SELECT event_id AS id, user_id, event_type AS action,
       CASE WHEN event_type IN ('view', 'click') THEN 'document'
            WHEN event_type = 'purchase' THEN 'calculation' ELSE 'approval' END AS entity_type,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS entity_id,
       CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS result_status,
       ts AS "timestamp"
FROM events"""


# ---------------------------------------------------------------- text tables
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model response bodies derived from event payloads.

    The body shape depends on the event type so that every parse branch is
    exercised: bare JSON, JSON wrapped in prose, empty, prose only, broken.
    """
    ev = text_table(spark, sf_dir, "events")
    body = (F.when(F.col("event_type") == "view", F.col("props"))
            .when(F.col("event_type") == "click",
                  F.concat(F.lit("Here is the result:\n"), F.col("props"), F.lit("\nDone.")))
            .when(F.col("event_type") == "error", F.lit(""))
            .when(F.col("event_type") == "signup",
                  F.concat(F.lit("No structured answer, value "), F.col("value").cast("string")))
            .otherwise(F.concat(F.lit("{\"k\": "), F.col("user_id").cast("string"), F.lit(", oops {"))))
    return ev.select(
        F.col("event_id").alias("response_id"),
        body.alias("content"),
        F.concat(F.lit("model-"), F.col("event_type")).alias("model"),
        F.col("ts").alias("created_at"),
        F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"),
        F.ceil("value").cast("bigint").alias("output_tokens"),
    )


RESPONSES_SQL = """
SELECT event_id AS response_id,
       CASE WHEN event_type = 'view' THEN props
            WHEN event_type = 'click' THEN 'Here is the result:' || chr(10) || props || chr(10) || 'Done.'
            WHEN event_type = 'error' THEN ''
            WHEN event_type = 'signup' THEN 'No structured answer, value ' || CAST(value AS VARCHAR)
            ELSE '{"k": ' || CAST(user_id AS VARCHAR) || ', oops {' END AS content,
       'model-' || event_type AS model,
       ts AS created_at,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens,
       CAST(ceil(value) AS BIGINT) AS output_tokens
FROM events"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL texts to lint, one per event, built from the event's fields."""
    ev = text_table(spark, sf_dir, "events")
    text = F.concat(
        F.lit("SELECT event_id, "), F.col("event_type"), F.lit("_score, ts FROM events WHERE value > "),
        F.get_json_object("props", "$.k"),
        F.when(F.col("event_type") == "error", F.lit(" AND user_id IS NOT NULL ORDER BY ts DESC"))
         .when(F.col("event_type") == "view", F.lit(" GROUP BY event_id HAVING COUNT(*) > 1"))
         .otherwise(F.lit("")),
    )
    return ev.select(F.col("event_id").alias("query_id"), text.alias("sql_text"))


QUERY_LOG_SQL = """
SELECT event_id AS query_id,
       'SELECT event_id, ' || event_type || '_score, ts FROM events WHERE value > '
       || json_extract_string(props, '$.k')
       || CASE WHEN event_type = 'error' THEN ' AND user_id IS NOT NULL ORDER BY ts DESC'
               WHEN event_type = 'view' THEN ' GROUP BY event_id HAVING COUNT(*) > 1'
               ELSE '' END AS sql_text
FROM events"""

STATEMENTS_PER_TASK = 50_000


def statement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with literals, comments, aliases, CTEs and quoted names, one per event; dealt for the fold over their tokens."""
    from covenant.sources.files import spread_rows
    ev = spread_rows(table(spark, sf_dir, "events"), STATEMENTS_PER_TASK)
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    text = (F.when(kind == "view", F.concat(F.lit("SELECT e.event_id, 'weak words ''"), kind, F.lit("'' here' AS label, e.value * "), user,
                                            F.lit(" scaled FROM events AS e WHERE e.props <> 'x' ORDER BY scaled")))
            .when(kind == "click", F.concat(F.lit("WITH recent AS (SELECT event_id, value FROM events) SELECT r.event_id, x.ts FROM recent r -- all "),
                                            user, F.lit("\nWHERE value > 3")))
            .when(kind == "purchase", F.concat(F.lit("SELECT max(value) AS peak, user_"), user, F.lit(" FROM events GROUP BY event_type")))
            .when(kind == "error", F.concat(F.lit("SELECT event_id FROM events, archive_"), user, F.lit(" WHERE ghost = 1")))
            .otherwise(F.lit('SELECT "event_id", count(*) FROM events /* ghost */ GROUP BY "event_id"')))
    return ev.select(F.col("event_id").alias("query_id"), text.alias("sql_text"))


QUERY_LOG_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def raw_orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders rendered as text with injected bad values, input of the coercion gate."""
    o = text_table(spark, sf_dir, "orders")
    bad = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
    return o.select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderkey").cast("string").alias("id_txt"),
        F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "No")
         .alias("flag_txt"),
        F.when(bad, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("amount_txt"),
        F.when(bad, "unknown").otherwise(F.to_date("o_orderdate").cast("string")).alias("date_txt"),
        F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.col("o_custkey").cast("string"))
         .alias("mixed_txt"),
        F.col("o_orderpriority").alias("prio_txt"),
        F.when(F.col("o_orderstatus") == "X", "x").alias("empty_txt"),
    )


RAW_ORDERS_TEXT_SQL = """
SELECT o_orderkey AS order_key, CAST(o_orderkey AS VARCHAR) AS id_txt,
       CASE WHEN o_orderstatus = 'F' THEN 'yes' WHEN o_orderstatus = 'O' THEN 'No' END AS flag_txt,
       CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'n/a'
            ELSE CAST(o_totalprice AS VARCHAR) END AS amount_txt,
       CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'unknown'
            ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date_txt,
       CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE CAST(o_custkey AS VARCHAR) END AS mixed_txt,
       o_orderpriority AS prio_txt,
       CASE WHEN o_orderstatus = 'X' THEN 'x' END AS empty_txt
FROM orders"""


# ---------------------------------------------------------------- contract terms
# FIXED VALUES: the two rule sets contracts are written with (standard follows
# the sample contract's tiers; strict is the tighter variant).
STANDARD_RULES_JSON = (
    '[{"rule_id": "RULE_001", "metric": "uptime_percent", "threshold": 99.0, "threshold_operator": "<", '
    '"penalty_amount": 500, "penalty_type": "monetary", "penalty_percentage": 5, '
    '"description": "5% of the monthly fee if uptime falls below 99%", "applicable_period": "monthly"}, '
    '{"rule_id": "RULE_002", "metric": "uptime_percent", "threshold": 98.9, "threshold_operator": "<", '
    '"penalty_amount": 1000, "penalty_type": "monetary", "penalty_percentage": 10, '
    '"description": "10% of the monthly fee if uptime falls below 98.9%", "applicable_period": "monthly"}, '
    '{"rule_id": "RULE_003", "metric": "uptime_percent", "threshold": 98.0, "threshold_operator": "<", '
    '"penalty_amount": 1500, "penalty_type": "monetary", "penalty_percentage": 15, '
    '"description": "15% of the monthly fee if uptime falls below 98%", "applicable_period": "monthly"}, '
    '{"rule_id": "RULE_004", "metric": "uptime_percent", "threshold": 95.0, "threshold_operator": "<", '
    '"penalty_amount": 2500, "penalty_type": "monetary", "penalty_percentage": 25, '
    '"description": "25% of the monthly fee if uptime falls below 95%", "applicable_period": "monthly"}, '
    '{"rule_id": "RULE_005", "metric": "avg_response_time", "threshold": 2.0, "threshold_operator": ">", '
    '"penalty_amount": 200, "penalty_type": "monetary", "penalty_percentage": 2, '
    '"description": "2% per incident when response time exceeds 2 seconds", "applicable_period": "per incident"}, '
    '{"rule_id": "RULE_006", "metric": "avg_response_time", "threshold": 5.0, "threshold_operator": ">", '
    '"penalty_amount": 500, "penalty_type": "monetary", "penalty_percentage": 5, '
    '"description": "5% per incident when response time exceeds 5 seconds", "applicable_period": "per incident"}, '
    '{"rule_id": "RULE_007", "metric": "avg_response_time", "threshold": 10.0, "threshold_operator": ">", '
    '"penalty_amount": 1000, "penalty_type": "monetary", "penalty_percentage": 10, '
    '"description": "10% per incident when response time exceeds 10 seconds", "applicable_period": "per incident"}]')
STRICT_RULES_JSON = (
    '[{"rule_id": "RULE_001", "metric": "uptime_percent", "threshold": 99.5, "threshold_operator": "<", '
    '"penalty_amount": 500, "penalty_type": "monetary", "penalty_percentage": 5, '
    '"description": "5% below 99.5%", "applicable_period": "monthly"}, '
    '{"rule_id": "RULE_002", "metric": "uptime_percent", "threshold": 98.5, "threshold_operator": "<", '
    '"penalty_amount": 1500, "penalty_type": "monetary", "penalty_percentage": 15, '
    '"description": "15% below 98.5%", "applicable_period": "monthly"}, '
    '{"rule_id": "RULE_003", "metric": "uptime_percent", "threshold": 96.0, "threshold_operator": "<=", '
    '"penalty_amount": 2500, "penalty_type": "monetary", "penalty_percentage": 25, '
    '"description": "25% at or below 96%", "applicable_period": "monthly"}, '
    '{"rule_id": "RULE_004", "metric": "avg_response_time", "threshold": 1.5, "threshold_operator": ">", '
    '"penalty_amount": 200, "penalty_type": "monetary", "penalty_percentage": 2, '
    '"description": "2% per incident above 1.5 seconds", "applicable_period": "per incident"}, '
    '{"rule_id": "RULE_005", "metric": "avg_response_time", "threshold": 8.0, "threshold_operator": ">=", '
    '"penalty_amount": 800, "penalty_type": "monetary", "penalty_percentage": 8, '
    '"description": "8% per incident at or above 8 seconds", "applicable_period": "per incident"}, '
    '{"rule_id": "RULE_006", "metric": "error_rate", "threshold": 0.3, "threshold_operator": ">", '
    '"penalty_amount": 300, "penalty_type": "monetary", "penalty_percentage": 3, '
    '"description": "3% per incident when the error rate exceeds 0.3", "applicable_period": "per incident"}, '
    '{"rule_id": "RULE_007", "metric": "error_rate", "threshold": 0.5, "threshold_operator": "=", '
    '"penalty_amount": 500, "penalty_type": "monetary", "penalty_percentage": 5, '
    '"description": "5% when the error rate is exactly 0.5", "applicable_period": "per incident"}]')
STANDARD_CONDITIONS_JSON = (
    '[{"metric": "uptime_percent", "condition": "uptime_percent < 99", "penalty_rule": "credit by uptime tier"}, '
    '{"metric": "avg_response_time", "condition": "avg_response_time > 2", "penalty_rule": "credit per incident"}]')
STRICT_CONDITIONS_JSON = (
    '[{"metric": "uptime_percent", "condition": "uptime_percent < 99.5", "penalty_rule": "credit by uptime tier"}, '
    '{"metric": "avg_response_time", "condition": "avg_response_time > 1.5", "penalty_rule": "credit per incident"}, '
    '{"metric": "error_rate", "condition": "error_rate > 0.3", "penalty_rule": "credit per incident"}]')
STANDARD_FIELDS_JSON = '["incident_date", "uptime_percent", "avg_response_time"]'
STRICT_FIELDS_JSON = '["incident_date", "uptime_percent", "avg_response_time", "error_rate", "availability_zone"]'


def rule_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extracted-terms response per contract — a contract per supplier,
    so the rule table grows with the data. Suppliers with a low balance
    sign the strict rule set; the fee steps with the balance band."""
    sp = table(spark, sf_dir, "supplier")
    bal = F.col("s_acctbal")
    strict = bal < 2000
    band = F.when(bal < 0, 0).when(bal < 2500, 1).when(bal < 5000, 2).when(bal < 7500, 3).otherwise(4)
    content = F.concat(
        F.lit('{"sla_rules": '), F.when(strict, F.lit(STRICT_RULES_JSON)).otherwise(F.lit(STANDARD_RULES_JSON)),
        F.lit(', "violation_conditions": '),
        F.when(strict, F.lit(STRICT_CONDITIONS_JSON)).otherwise(F.lit(STANDARD_CONDITIONS_JSON)),
        F.lit(', "sql_query": "SELECT incident_date, uptime_percent FROM billing", "data_fields_required": '),
        F.when(strict, F.lit(STRICT_FIELDS_JSON)).otherwise(F.lit(STANDARD_FIELDS_JSON)),
        F.lit(', "monthly_service_fee": '), (F.lit(10000) + band * 1000).cast("string"),
        F.lit(', "max_monthly_penalty_percentage": '),
        F.when(bal < 0, F.lit("25")).otherwise(F.lit("30")), F.lit("}"))
    return sp.select(F.col("s_suppkey").alias("contract_id"), content.alias("content"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


RULE_RESPONSES_SQL = f"""
SELECT s_suppkey AS contract_id,
       '{{"sla_rules": ' || CASE WHEN s_acctbal < 2000 THEN {_q(STRICT_RULES_JSON)} ELSE {_q(STANDARD_RULES_JSON)} END
       || ', "violation_conditions": '
       || CASE WHEN s_acctbal < 2000 THEN {_q(STRICT_CONDITIONS_JSON)} ELSE {_q(STANDARD_CONDITIONS_JSON)} END
       || ', "sql_query": "SELECT incident_date, uptime_percent FROM billing", "data_fields_required": '
       || CASE WHEN s_acctbal < 2000 THEN {_q(STRICT_FIELDS_JSON)} ELSE {_q(STANDARD_FIELDS_JSON)} END
       || ', "monthly_service_fee": '
       || CAST(10000 + 1000 * CASE WHEN s_acctbal < 0 THEN 0 WHEN s_acctbal < 2500 THEN 1 WHEN s_acctbal < 5000 THEN 2
                                   WHEN s_acctbal < 7500 THEN 3 ELSE 4 END AS VARCHAR)
       || ', "max_monthly_penalty_percentage": ' || CASE WHEN s_acctbal < 0 THEN '25' ELSE '30' END || '}}' AS content
FROM supplier"""


def billing_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billing rows with their contract (the supplier that delivers them)."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier_id"),
                                                F.col("s_suppkey").alias("contract_id"))
    return billing(spark, sf_dir).join(s, "supplier_id", "inner")


BILLING_CONTRACTS_SQL = """
SELECT b.*, s.s_suppkey AS contract_id FROM billing b JOIN supplier s ON s.s_suppkey = b.supplier_id"""


def contract_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months a contract is in force: from 1995 or 1996 on, two to eight years."""
    sp = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    first = F.add_months(F.lit("1995-01-01").cast("date"), (k % 24).cast("int"))
    return sp.select(k.alias("contract_id"), first.alias("first_month"), F.add_months(first, (24 + k % 72).cast("int")).alias("last_month"))


CONTRACT_PERIODS_SQL = """
SELECT s_suppkey AS contract_id, CAST(DATE '1995-01-01' + to_months(CAST(s_suppkey % 24 AS INTEGER)) AS DATE) AS first_month,
       CAST(DATE '1995-01-01' + to_months(CAST(s_suppkey % 24 + 24 + s_suppkey % 72 AS INTEGER)) AS DATE) AS last_month
FROM supplier"""


def maintenance_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announced maintenance of a service: windows of 30 to 270 minutes, opened by large signup events."""
    ev = table(spark, sf_dir, "events").filter((F.col("event_type") == "signup") & (F.col("value") > 130))
    n = F.col("event_id")
    return ev.select(n.alias("window_id"), F.element_at(F.array(*[F.lit(s) for s in MAINTAINED]), (n % len(MAINTAINED) + 1).cast("int")).alias("service"),
                     F.when(F.col("user_id") % 3 == 0, "emergency").otherwise("scheduled").alias("kind"),
                     (F.col("user_id") % 97).cast("int").alias("notice_hours"), F.col("ts").alias("window_start"),
                     F.timestamp_add("MINUTE", (30 + 60 * (n % 5)).cast("int"), F.col("ts")).alias("window_end"))


MAINTAINED = ["view", "signup", "click", "error", "purchase"]

MAINTENANCE_SQL = f"""
SELECT event_id AS window_id, {MAINTAINED!r}[event_id % {len(MAINTAINED)} + 1] AS service,
       CASE WHEN user_id % 3 = 0 THEN 'emergency' ELSE 'scheduled' END AS kind,
       CAST(user_id % 97 AS INTEGER) AS notice_hours, ts AS window_start,
       ts + to_minutes(30 + 60 * (event_id % 5)) AS window_end
FROM events WHERE event_type = 'signup' AND value > 130"""


VIEW_SQL = {
    "billing": BILLING_SQL,
    "incidents": INCIDENTS_SQL,
    "cost_breakdowns": COST_BREAKDOWNS_SQL,
    "users": USERS_SQL,
    "ledger_documents": LEDGER_DOCUMENTS_SQL,
    "ledger_queries": LEDGER_QUERIES_SQL,
    "calculations": CALCULATIONS_SQL,
    "approvals": APPROVALS_SQL,
    "decision_log": DECISION_LOG_SQL,
    "audit_logs": AUDIT_LOGS_SQL,
    "responses": RESPONSES_SQL,
    "query_log": QUERY_LOG_SQL,
    "raw_orders_text": RAW_ORDERS_TEXT_SQL,
    "rule_responses": RULE_RESPONSES_SQL,
    "billing_contracts": BILLING_CONTRACTS_SQL,
    "maintenance_windows": MAINTENANCE_SQL,
    "contract_periods": CONTRACT_PERIODS_SQL,
}


_DEPENDS = {"billing_contracts": ["billing"]}


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix an oracle statement with the CTEs of the domain views it uses
    (plus ``extra`` statement-specific CTEs, in order)."""
    order: list[str] = []
    for n in names:
        for dep in _DEPENDS.get(n, []) + [n]:
            if dep not in order:
                order.append(dep)
    parts = [f"{n} AS ({VIEW_SQL[n]}\n)" for n in order]
    parts += [f"{n} AS ({body}\n)" for n, body in (extra or {}).items()]
    return f"WITH {', '.join(parts)}\n{sql}" if parts else sql
