"""Cost roll-ups, ledger joins, approval/proof/audit tables, filters, limits
(AGG-7..14/17..19/21, JN-1..5/8/9, FLT-*, LIM-1/3, SET-5, AUD-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenant import terms
from covenant.operators import costs as cs
from covenant.operators import execution as ex
from covenant.operators import ledger as lg
from covenant.operators import penalties as pen
from covenant.operators import proofs as pr
from covenant.operators import windows as wn
from covenant.plans import adapters as A
from covenant.plans.adapters import with_views
from covenant.plans.registry import register
from covenant.sources import schemas as sc
from covenant.sources import sinks as sk
from covenant.streaming import audit as au

AS_OF = "1998-08-01"
LINE_KEY = list(A.LINE_KEY)

# ------------------------------------------------------------------ costs
COST_RESULT_SQL = """
SELECT l_orderkey, l_linenumber, transaction_count, supplier_id, incident_date,
       CASE WHEN uptime_percent < 95.0 THEN 2500.0 WHEN uptime_percent < 98.0 THEN 1500.0
            WHEN uptime_percent < 98.9 THEN 1000.0 WHEN uptime_percent < 99.0 THEN 500.0 ELSE 0.0 END AS penalty_monetary,
       CASE WHEN avg_response_time > 10.0 THEN 10.0 WHEN avg_response_time > 5.0 THEN 5.0
            WHEN avg_response_time > 2.0 THEN 2.0 ELSE 0.0 END AS service_credits,
       round((100.0 - uptime_percent) / 100 * 24, 4) AS outage_hours,
       error_rate * 100 AS late_fee
FROM billing"""


def cost_result(spark, d):
    """A penalty result with cost columns named the way responses name them."""
    b = A.billing(spark, d)
    return b.select(*LINE_KEY, "incident_date",
                    pen.uptime_tier_penalty(F.col("uptime_percent")).alias("penalty_monetary"),
                    pen.tiered_pct(F.col("avg_response_time"), terms.RESPONSE_TIERS, ">").alias("service_credits"),
                    F.round((F.lit(100.0) - F.col("uptime_percent")) / 100 * 24, 4).alias("outage_hours"),
                    (F.col("error_rate") * 100).alias("late_fee"))


@register("cost_by_type", "AGG-7", oracle=with_views("""
SELECT cost_type, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total,
       CAST(coalesce(sum(amount), 0) AS DOUBLE) / (SELECT count(*) FROM cost_result) AS average, columns,
       count(*) FILTER (WHERE lost) AS lost_values
FROM (SELECT 'monetary' AS cost_type, TRY_CAST(penalty_monetary AS DECIMAL(18,4)) AS amount, 'penalty_monetary' AS columns,
             penalty_monetary IS NOT NULL AND TRY_CAST(penalty_monetary AS DECIMAL(18,4)) IS NULL AS lost FROM cost_result
      UNION ALL SELECT 'credits', TRY_CAST(service_credits AS DECIMAL(18,4)), 'service_credits', service_credits IS NOT NULL
             AND TRY_CAST(service_credits AS DECIMAL(18,4)) IS NULL FROM cost_result
      UNION ALL SELECT 'hours', TRY_CAST(outage_hours AS DECIMAL(18,4)), 'outage_hours', outage_hours IS NOT NULL
             AND TRY_CAST(outage_hours AS DECIMAL(18,4)) IS NULL FROM cost_result) u
GROUP BY cost_type, columns""", "billing", extra={"cost_result": COST_RESULT_SQL}))
def cost_by_type(spark, d):
    return cs.cost_by_type(cost_result(spark, d))


@register("cost_extraction", ("AGG-7", "AGG-8", "AGG-9"), oracle=with_views("""
SELECT 'credits=service_credits,hours=outage_hours,monetary=penalty_monetary' AS cost_types,
       CAST(sum(CAST(penalty_monetary AS DECIMAL(18,4))) + sum(CAST(service_credits AS DECIMAL(18,4))) + sum(CAST(outage_hours AS DECIMAL(18,4))) AS DOUBLE)
         AS grand_total,
       (SELECT string_agg(k, ',' ORDER BY l_orderkey, l_linenumber, transaction_count, supplier_id) FROM (
          SELECT *, l_orderkey || '/' || l_linenumber || '/' || transaction_count AS k FROM cost_result
          ORDER BY l_orderkey, l_linenumber, transaction_count, supplier_id LIMIT 10) s) AS sample_keys
FROM cost_result""", "billing", extra={"cost_result": COST_RESULT_SQL}))
def cost_extraction(spark, d):
    """The whole cost extraction of a penalty result in one record."""
    x = cs.cost_extraction(cost_result(spark, d), LINE_KEY)
    key = lambda j: F.concat_ws("/", *[F.get_json_object(j, f"$.{c}") for c in ("l_orderkey", "l_linenumber", "transaction_count")])
    return x.select(F.array_join(F.transform("cost_types", lambda t: F.concat_ws("=", t["cost_type"], t["columns"])), ",").alias("cost_types"), "grand_total",
                    F.array_join(F.transform("sample_rows", key), ",").alias("sample_keys"))


@register("cost_columns", "AGG-9", oracle=with_views("""
SELECT 'monetary' AS cost_type, 'penalty_monetary' AS column_name, count(penalty_monetary) AS parsed_values FROM cost_result
UNION ALL SELECT 'credits', 'service_credits', count(service_credits) FROM cost_result
UNION ALL SELECT 'hours', 'outage_hours', count(outage_hours) FROM cost_result""",
    "billing", extra={"cost_result": COST_RESULT_SQL}))
def cost_columns(spark, d):
    return (cs.cost_cells(cost_result(spark, d)).groupBy("cost_type", "column_name")
            .agg(F.count("amount").alias("parsed_values")))


@register("cost_grand_total", ("AGG-8", "SET-1"), oracle=with_views("""
SELECT cost_type, CAST(sum(calculated_cost) AS DOUBLE) AS amount FROM cost_breakdowns GROUP BY cost_type
UNION ALL SELECT 'all', CAST(sum(calculated_cost) AS DOUBLE) FROM cost_breakdowns""", "cost_breakdowns"))
def cost_grand_total(spark, d):
    return cs.totals_with_all(A.cost_breakdowns(spark, d), "calculated_cost")


@register("cost_by_period", "AGG-10", oracle=with_views("""
SELECT period_start, cost_type, CAST(sum(original_cost) AS DOUBLE) AS original,
       CAST(sum(calculated_cost) AS DOUBLE) AS calculated, CAST(sum(delta_cost) AS DOUBLE) AS delta, count(*) AS lines
FROM cost_breakdowns GROUP BY ALL""", "cost_breakdowns"))
def cost_by_period(spark, d):
    return cs.cost_by_period(A.cost_breakdowns(spark, d))


@register("proof_summary", "AGG-11", oracle=with_views("""
SELECT 'total' AS level, '*' AS key, CAST(sum(original_cost) AS DOUBLE) AS original,
       CAST(sum(calculated_cost) AS DOUBLE) AS calculated, CAST(sum(delta_cost) AS DOUBLE) AS delta FROM cost_breakdowns
UNION ALL SELECT 'by_type', cost_type, CAST(sum(original_cost) AS DOUBLE), CAST(sum(calculated_cost) AS DOUBLE),
       CAST(sum(delta_cost) AS DOUBLE) FROM cost_breakdowns GROUP BY cost_type
UNION ALL SELECT 'by_currency', coalesce(cost_currency, 'USD'), NULL, CAST(sum(calculated_cost) AS DOUBLE), NULL
       FROM cost_breakdowns GROUP BY coalesce(cost_currency, 'USD')""", "cost_breakdowns"))
def proof_summary(spark, d):
    return cs.proof_summary(A.cost_breakdowns(spark, d))


@register("cost_type_stats", "AGG-12", oracle=with_views("""
SELECT cost_type, count(calculated_cost) AS count, CAST(sum(calculated_cost) AS DOUBLE) AS total,
       round(CAST(sum(calculated_cost) AS DOUBLE) / count(calculated_cost), 6) AS average,
       CAST(min(calculated_cost) AS DOUBLE) AS min, CAST(max(calculated_cost) AS DOUBLE) AS max
FROM cost_breakdowns GROUP BY cost_type""", "cost_breakdowns"))
def cost_type_stats(spark, d):
    return cs.cost_type_stats(A.cost_breakdowns(spark, d))


@register("cost_summary", "AGG-13", oracle=with_views("""
SELECT 'by_type' AS level, cost_type, CAST(NULL AS DATE) AS period_start,
       CAST(sum(calculated_cost) AS DOUBLE) AS amount, count(*) AS lines FROM cost_breakdowns GROUP BY cost_type
UNION ALL SELECT 'by_period', NULL, period_start, CAST(sum(calculated_cost) AS DOUBLE), count(*)
       FROM cost_breakdowns GROUP BY period_start
UNION ALL SELECT 'total', NULL, NULL, CAST(sum(calculated_cost) AS DOUBLE), count(*) FROM cost_breakdowns""",
    "cost_breakdowns"))
def cost_summary(spark, d):
    return cs.cost_summary(A.cost_breakdowns(spark, d))


@register("cost_delta", "JN-5", oracle=with_views("""
SELECT coalesce(o.period_start, c.period_start) AS period_start, coalesce(o.amount, 0.0) AS original,
       coalesce(c.amount, 0.0) AS calculated, coalesce(c.amount, 0.0) - coalesce(o.amount, 0.0) AS delta
FROM (SELECT period_start, CAST(sum(original_cost) AS DOUBLE) AS amount FROM cost_breakdowns GROUP BY period_start) o
FULL OUTER JOIN (SELECT CAST(period_start + INTERVAL 1 MONTH AS DATE) AS period_start, CAST(sum(calculated_cost) AS DOUBLE) AS amount
      FROM cost_breakdowns GROUP BY ALL) c ON o.period_start = c.period_start""", "cost_breakdowns"))
def cost_delta(spark, d):
    """All lines on both sides: billed by period, settled in the following month."""
    cb = A.cost_breakdowns(spark, d)
    o = cb.groupBy("period_start").agg(F.sum("original_cost").cast("double").alias("amount"))
    c = (cb.groupBy(F.add_months("period_start", 1).alias("period_start"))
         .agg(F.sum("calculated_cost").cast("double").alias("amount")))
    return cs.cost_delta(o, c, "period_start")


@register("cost_filter", "FLT-8", oracle=with_views("""
SELECT l_orderkey, l_linenumber, cost_type, period_start, CAST(calculated_cost AS DOUBLE) AS calculated_cost
FROM cost_breakdowns
WHERE cost_type = 'credits' AND period_start <= DATE '1997-12-31' AND period_end >= DATE '1997-01-01'""",
    "cost_breakdowns"))
def cost_filter(spark, d):
    return lg.filter_costs(A.cost_breakdowns(spark, d), cost_type="credits", start="1997-01-01", end="1997-12-31") \
        .select("l_orderkey", "l_linenumber", "cost_type", "period_start",
                F.col("calculated_cost").cast("double").alias("calculated_cost"))


@register("dashboard_stats", "AGG-14", oracle=with_views(f"""
SELECT (SELECT count(*) FROM ledger_documents) AS documents,
       (SELECT count(*) FROM calculations) AS calculations,
       (SELECT count(*) FROM approvals WHERE request_status = 'pending') AS pending_approvals,
       (SELECT count(*) FROM approvals WHERE request_status = 'approved') AS completed_proofs,
       (SELECT CAST(coalesce(-sum(c.delta_cost), 0) AS DOUBLE) FROM cost_breakdowns c
          JOIN approvals a ON a.calculation_id = c.calculation_id WHERE a.request_status = 'approved') AS total_recovery,
       (SELECT CAST(coalesce(-sum(c.delta_cost), 0) AS DOUBLE) FROM cost_breakdowns c
          JOIN approvals a ON a.calculation_id = c.calculation_id
          WHERE a.request_status = 'approved' AND a.approval_date > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY
            AND a.approval_date <= TIMESTAMP '{AS_OF}') AS recent_recovery""",
    "ledger_documents", "calculations", "approvals", "cost_breakdowns"))
def dashboard_stats(spark, d):
    return lg.dashboard(A.ledger_documents(spark, d), A.calculations(spark, d), A.approvals(spark, d),
                        A.cost_breakdowns(spark, d), AS_OF)


# ------------------------------------------------------------------ ledger joins
CHAIN_SQL = """
SELECT a.id AS approval_id, c.id AS calculation_id, q.id AS query_id, doc.id AS document_id,
       doc.filename, doc.document_type, c.execution_status, a.approval_date
FROM approvals a JOIN calculations c ON c.id = a.calculation_id JOIN ledger_queries q ON q.id = c.query_id
JOIN ledger_documents doc ON doc.id = q.document_id WHERE a.request_status = 'approved'"""


@register("proof_chain", "JN-1", oracle=with_views(CHAIN_SQL, "approvals", "calculations", "ledger_queries",
                                                  "ledger_documents"))
def proof_chain(spark, d):
    return lg.proof_chain(A.approvals(spark, d), A.calculations(spark, d), A.ledger_queries(spark, d),
                          A.ledger_documents(spark, d))


@register("cost_left", "JN-2", oracle=with_views("""
SELECT c.id AS calculation_id, coalesce(k.lines, 0) AS cost_lines, k.calculated, k.delta
FROM calculations c LEFT JOIN (SELECT calculation_id, count(*) AS lines, CAST(sum(calculated_cost) AS DOUBLE) AS calculated,
                                      CAST(sum(delta_cost) AS DOUBLE) AS delta
                               FROM cost_breakdowns GROUP BY calculation_id) k ON k.calculation_id = c.id""",
    "calculations", "cost_breakdowns"))
def cost_left(spark, d):
    return lg.costs_per_calculation(A.calculations(spark, d), A.cost_breakdowns(spark, d))


@register("approver_left", "JN-3", oracle=with_views("""
SELECT a.id AS approval_id, a.request_status, u.username AS approved_by, u.email AS approver_email
FROM approvals a LEFT JOIN users u ON u.id = a.approved_by""", "approvals", "users"))
def approver_left(spark, d):
    return lg.with_approver(A.approvals(spark, d), A.users(spark, d))


@register("queries_per_document", "JN-4", oracle=with_views("""
SELECT doc.id AS document_id, count(q.id) AS queries, count(q.id) FILTER (WHERE q.validation_status = 'valid') AS valid_queries
FROM ledger_documents doc LEFT JOIN ledger_queries q ON q.document_id = doc.id GROUP BY doc.id""",
    "ledger_documents", "ledger_queries"))
def queries_per_document(spark, d):
    return lg.queries_per_document(A.ledger_documents(spark, d), A.ledger_queries(spark, d))


@register("runs_per_query", ("AUD-9",), oracle=with_views("""
SELECT q.id AS query_id, count(c.id) AS runs, arg_max(c.id, (c.executed_at, c.id)) AS latest_run,
       arg_max(c.execution_status, (c.executed_at, c.id)) AS latest_status
FROM ledger_queries q LEFT JOIN calculations c ON c.query_id = q.id GROUP BY q.id""",
    "ledger_queries", "calculations"))
def runs_per_query(spark, d):
    return lg.runs_per_query(A.ledger_queries(spark, d), A.calculations(spark, d))


def _DOCS_SQL():
    from covenant.plans.q_text import DOCS_SQL
    return DOCS_SQL


REGISTRY_VALUES = ", ".join(f"('{n}', {len(k)})" for n, _dsc, k in terms.DOCUMENT_TYPES)


@register("type_fallback", ("JN-8",), oracle=with_views(f"""
SELECT doc.doc_id AS document_id, doc.document_type, coalesce(r.name, 'custom') AS resolved_type,
       coalesce(r.n_outputs, g.n_outputs) AS expected_outputs
FROM docs doc
LEFT JOIN (VALUES {REGISTRY_VALUES}) r(name, n_outputs) ON r.name = lower(doc.document_type)
JOIN (VALUES {REGISTRY_VALUES}) g(name, n_outputs) ON g.name = 'custom'""", extra={"docs": _DOCS_SQL()}))
def type_fallback(spark, d):
    from covenant.plans.q_text import docs_in
    docs = docs_in(spark, d).select(F.col("doc_id").alias("document_id"), "document_type")
    r = lg.resolve_types(docs, "document_type")
    return r.select("document_id", "document_type", "resolved_type",
                    F.size("expected_outputs").alias("expected_outputs"))


SELF_JOIN_SQL = ("SELECT c.id AS calculation_id, c.query_id, p.id AS previous_id, "
                 "round(c.result_value - p.result_value, 4) AS change "
                 "FROM calculations c LEFT JOIN calculations p ON p.query_id = c.query_id AND p.id + 1 = c.id")


@register("sql_self_join", "JN-9", oracle=with_views(SELF_JOIN_SQL, "calculations"))
def sql_self_join(spark, d):
    return ex.run_sql(spark, SELF_JOIN_SQL, {"calculations": A.calculations(spark, d)})


SET_OPS_SQL = ("SELECT supplier_id FROM billing WHERE uptime_percent < 95 "
               "INTERSECT SELECT supplier_id FROM billing WHERE avg_response_time > 12 "
               "UNION SELECT supplier_id FROM billing WHERE error_rate > 0.49 "
               "EXCEPT SELECT supplier_id FROM billing WHERE transaction_count < 5")


@register("set_ops", "SET-5", oracle=with_views(SET_OPS_SQL, "billing"))
def set_ops(spark, d):
    return ex.run_sql(spark, SET_OPS_SQL, {"billing": A.billing(spark, d)})


# ------------------------------------------------------------------ workflow
@register("approval_queue", "AUD-1", oracle=with_views("""
SELECT c.id AS calculation_id, c.query_id, c.executed_at, a.requires_escalation
FROM calculations c LEFT JOIN approvals a ON a.calculation_id = c.id
WHERE c.execution_status = 'success' AND (a.id IS NULL OR a.request_status = 'pending')""", "calculations", "approvals"))
def approval_queue(spark, d):
    return lg.approval_queue(A.calculations(spark, d), A.approvals(spark, d))


@register("approval_fold", ("AUD-2", "WIN-3"), oracle=with_views("""
SELECT calculation_id,
       CASE arg_max(decision, (decided_at, decision_id)) FILTER (WHERE decision <> 'hold')
            WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'escalate' THEN 'escalated'
            WHEN 'revoke' THEN 'revoked' ELSE CASE WHEN count(*) FILTER (WHERE decision <> 'hold') = 0 THEN 'pending' ELSE 'unknown' END END AS state,
       max(decided_at) FILTER (WHERE decision <> 'hold') AS decided_at,
       count(*) AS decisions
FROM decision_log GROUP BY calculation_id""", "decision_log"))
def approval_fold(spark, d):
    return lg.fold_decisions(A.decision_log(spark, d))


@register("latest_state", "WIN-3", oracle=with_views("""
SELECT user_id, arg_max(action, ("timestamp", id)) AS action, arg_max(entity_type, ("timestamp", id)) AS entity_type,
       max("timestamp") AS "timestamp"
FROM audit_logs GROUP BY user_id""", "audit_logs"))
def latest_state(spark, d):
    return wn.latest_per_key(A.audit_logs(spark, d), ["user_id"], ["timestamp", "id"],
                             ["action", "entity_type", "timestamp"])


#: Lines of a leaf in these queries: small, so that the test data's calculations get trees of two levels.
LEAF = 4
LINES_CTE = """
SELECT calculation_id, l_linenumber, CAST(json_object(
         'calculated_cost', CAST(CAST(calculated_cost AS DECIMAL(18,4)) AS VARCHAR), 'cost_currency', cost_currency, 'cost_details', cost_details,
         'cost_type', cost_type, 'cost_unit', cost_unit, 'delta_cost', CAST(CAST(delta_cost AS DECIMAL(18,4)) AS VARCHAR),
         'original_cost', CAST(CAST(original_cost AS DECIMAL(18,2)) AS VARCHAR),
         'period_end', CAST(CAST(period_end AS DATE) AS VARCHAR), 'period_start', CAST(CAST(period_start AS DATE) AS VARCHAR)) AS VARCHAR) AS line
FROM cost_breakdowns"""
DEPTH_CTE = f"SELECT calculation_id, CASE WHEN count(DISTINCT line) > {LEAF} THEN 1 ELSE 0 END AS depth FROM cost_json GROUP BY calculation_id"


def root_sql(lines: str) -> str:
    """Digest roots of the lines in a table, with the depths of ``line_depths``."""
    return f"""
SELECT calculation_id, depth, CASE WHEN depth = 0 THEN min(digest)
       ELSE sha256(string_agg(prefix || ':' || digest, chr(10) ORDER BY prefix || ':' || digest)) END AS root
FROM (SELECT calculation_id, depth, substr(h, 1, depth) AS prefix, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h || ':' || n)) AS digest
      FROM (SELECT calculation_id, depth, sha256(line) AS h, CAST(count(*) AS VARCHAR) AS n
            FROM {lines} JOIN line_depths USING (calculation_id) GROUP BY ALL) a GROUP BY ALL) b GROUP BY calculation_id, depth"""


SUMMARY_CTE = """
SELECT calculation_id, cost_lines, total_original, total_calculated, total_delta, by_type, by_currency
FROM (SELECT calculation_id, count(*) AS cost_lines, CAST(sum(original_cost) AS DECIMAL(28,4)) AS total_original,
             CAST(sum(calculated_cost) AS DECIMAL(28,4)) AS total_calculated, CAST(sum(delta_cost) AS DECIMAL(28,4)) AS total_delta
      FROM cost_breakdowns GROUP BY calculation_id) t
JOIN (SELECT calculation_id, string_agg(x, ',' ORDER BY x) AS by_type
      FROM (SELECT calculation_id, cost_type || '=' || CAST(CAST(sum(original_cost) AS DECIMAL(28,4)) AS VARCHAR) || '/'
                   || CAST(CAST(sum(calculated_cost) AS DECIMAL(28,4)) AS VARCHAR) || '/' || CAST(CAST(sum(delta_cost) AS DECIMAL(28,4)) AS VARCHAR) AS x
            FROM cost_breakdowns GROUP BY calculation_id, cost_type) a GROUP BY calculation_id) b USING (calculation_id)
JOIN (SELECT calculation_id, string_agg(x, ',' ORDER BY x) AS by_currency
      FROM (SELECT calculation_id, coalesce(cost_currency, 'USD') || '=' || CAST(CAST(sum(calculated_cost) AS DECIMAL(28,4)) AS VARCHAR) AS x
            FROM cost_breakdowns GROUP BY calculation_id, coalesce(cost_currency, 'USD')) a GROUP BY calculation_id) c USING (calculation_id)"""
PROOF_CTE = f"""
SELECT strftime(a.approval_date, '%Y-%m-%dT%H:%M:%S') AS approval_date, a.id AS approval_id, u.username AS approved_by, a.approver_comments,
       u.email AS approver_email, coalesce(s.by_currency, '') AS by_currency, coalesce(s.by_type, '') AS by_type, c.id AS calculation_id,
       '{pr.METADATA["compliance_scope"]}' AS compliance_scope, q.extracted_terms AS contract_terms,
       CAST(coalesce(s.cost_lines, 0) AS BIGINT) AS cost_lines, doc.id AS document_id, doc.document_type, c.execution_status, doc.filename,
       '{pr.METADATA["generation_method"]}' AS generation_method, coalesce(r.depth, 0) AS lines_depth, coalesce(r.root, sha256('')) AS lines_root,
       q.extraction_confidence AS query_confidence, a.requires_escalation, c.result_rows_count AS rows_processed,
       array_to_string(c.result_data[1:20], chr(10)) AS sample_evidence, c.sanity_check_details, c.sanity_check_status, q.query_text AS sql_query,
       '{pr.METADATA["system_version"]}' AS system_version, CAST(coalesce(s.total_calculated, 0) AS DECIMAL(28,4)) AS total_calculated,
       CAST(coalesce(s.total_delta, 0) AS DECIMAL(28,4)) AS total_delta, CAST(coalesce(s.total_original, 0) AS DECIMAL(28,4)) AS total_original,
       strftime(doc.upload_date, '%Y-%m-%dT%H:%M:%S') AS upload_date
FROM approvals a JOIN calculations c ON c.id = a.calculation_id JOIN ledger_queries q ON q.id = c.query_id
JOIN ledger_documents doc ON doc.id = q.document_id LEFT JOIN users u ON u.id = a.approved_by
LEFT JOIN summaries s ON s.calculation_id = c.id LEFT JOIN line_roots r ON r.calculation_id = c.id
WHERE a.request_status = 'approved'"""
PROOF_CTES = {"cost_json": LINES_CTE, "line_depths": DEPTH_CTE, "line_roots": root_sql("cost_json"), "summaries": SUMMARY_CTE, "proofs": PROOF_CTE}
CANON_SQL = "CAST(json_object(" + ", ".join(f"'{f}', CAST({f} AS VARCHAR)" for f in pr.HEAD_FIELDS) + ") AS VARCHAR)"
PROOF_VIEWS = ("approvals", "calculations", "ledger_queries", "ledger_documents", "users", "cost_breakdowns")


def line_tree(hashes, most):
    return pr.tree_steps(hashes, pr.depths(hashes, LEAF), pr.top_depth(most, LEAF))


def proofs(spark, d):
    costs = A.cost_breakdowns(spark, d)
    return pr.proof_heads(A.approvals(spark, d), A.calculations(spark, d), A.ledger_queries(spark, d), A.ledger_documents(spark, d),
                          A.users(spark, d), costs, pr.over_calculations([costs], lambda h, most, whole: pr.roots(line_tree(h, most))))


def altered_costs(spark, d):
    """Cost lines after the loss of every seventh line of a calculation."""
    return A.cost_breakdowns(spark, d).where("l_linenumber <> 7")


ALTERED_CTES = PROOF_CTES | {"altered_json": "SELECT * FROM cost_json WHERE l_linenumber <> 7", "altered_roots": root_sql("altered_json")}


@register("proof_doc", "AUD-3", oracle=with_views(
    "SELECT * REPLACE (CAST(total_original AS DOUBLE) AS total_original, CAST(total_calculated AS DOUBLE) AS total_calculated, "
    "CAST(total_delta AS DOUBLE) AS total_delta) FROM proofs", *PROOF_VIEWS, extra=PROOF_CTES))
def proof_doc(spark, d):
    return proofs(spark, d).withColumns({c: F.col(c).cast("double") for c in ("total_original", "total_calculated", "total_delta")})


@register("proof_lines", "AUD-3", oracle=with_views(
    "SELECT approval_id, calculation_id, line, CAST(count(*) AS BIGINT) AS count FROM cost_json JOIN (SELECT id AS approval_id, calculation_id FROM approvals "
    "WHERE request_status = 'approved') a USING (calculation_id) GROUP BY ALL", "approvals", "cost_breakdowns", extra={"cost_json": LINES_CTE}))
def proof_lines(spark, d):
    """The cost lines of every proof, as rows of their own."""
    a = A.approvals(spark, d).where("request_status = 'approved'").select(F.col("id").alias("approval_id"), "calculation_id")
    return pr.proof_lines(A.cost_breakdowns(spark, d), a).select("approval_id", "calculation_id", "line", "count")


@register("proof_hash", "AUD-4", oracle=with_views(f"SELECT approval_id, sha256({CANON_SQL}) AS proof_hash FROM proofs", *PROOF_VIEWS, extra=PROOF_CTES))
def proof_hash(spark, d):
    return pr.with_proof_hash(proofs(spark, d)).select("approval_id", "proof_hash")


@register("proof_verify", "AUD-5", oracle=with_views("""
SELECT approval_id, NOT requires_escalation AND cost_lines <= 5 AS head_ok, coalesce(r.root, sha256('')) = lines_root AS lines_ok,
       NOT requires_escalation AND cost_lines <= 5 AND coalesce(r.root, sha256('')) = lines_root AS verified
FROM proofs LEFT JOIN altered_roots r USING (calculation_id)""", *PROOF_VIEWS, extra=ALTERED_CTES))
def proof_verify(spark, d):
    """Proofs stored without a hash where escalated, with another file name where they have over five lines, and less a cost line."""
    stored = pr.with_proof_hash(proofs(spark, d)).withColumn("proof_hash", F.when(~F.col("requires_escalation"), F.col("proof_hash")))
    stored = stored.withColumn("filename", F.when(F.col("cost_lines") > 5, F.lit("tampered.txt")).otherwise(F.col("filename")))
    lines = [part for part, in pr.line_parts([altered_costs(spark, d)])[0]]
    return pr.verify(stored, lines).select("approval_id", "head_ok", "lines_ok", "verified")


@register("proof_altered", "AUD-5", oracle=with_views("""
SELECT calculation_id, sha256(line) AS line_hash, CAST(count(*) AS BIGINT) AS before,
       CAST(count(*) FILTER (WHERE l_linenumber <> 7) AS BIGINT) AS after
FROM cost_json GROUP BY calculation_id, line HAVING count(*) FILTER (WHERE l_linenumber = 7) > 0""",
    "cost_breakdowns", extra={"cost_json": LINES_CTE}))
def proof_altered(spark, d):
    """The lines that the stored trees have and the altered ledger has not."""
    def compare(stored, current, most, whole):
        levels, top = pr.depths(stored, LEAF), pr.top_depth(most, LEAF)
        return pr.altered_lines(pr.tree_steps(stored, levels, top)[0], pr.tree_steps(current, levels, top)[0], whole)

    return pr.over_calculations([A.cost_breakdowns(spark, d), altered_costs(spark, d)], compare)


@register("proof_inclusion", "AUD-5", oracle=with_views("""
SELECT calculation_id, line, included FROM (SELECT calculation_id, min(line) AS line, TRUE AS included FROM cost_json GROUP BY calculation_id
UNION ALL SELECT calculation_id, min(line) || ' ', FALSE FROM cost_json GROUP BY calculation_id) x""",
    "cost_breakdowns", extra={"cost_json": LINES_CTE}))
def proof_inclusion(spark, d):
    """The path of one genuine and one forged line of every calculation, checked against its root."""
    costs = A.cost_breakdowns(spark, d)
    least = pr.line_texts(costs).groupBy("calculation_id").agg(F.min("line").alias("line"))
    asked = least.select("calculation_id", F.explode(F.array("line", F.concat("line", F.lit(" ")))).alias("line"))

    def check(hashes, most, whole):
        tree = line_tree(hashes, most)
        return pr.check_inclusion(pr.inclusion_proof(asked, tree, whole), pr.roots(tree))

    return pr.over_calculations([costs], check)


@register("proof_id", "AUD-6", oracle=with_views("""
SELECT id AS approval_id,
       substr(sha256(CAST(id AS VARCHAR) || strftime(approval_date, '%Y-%m-%dT%H:%M:%S')), 1, 16) AS proof_id
FROM approvals WHERE request_status = 'approved'""", "approvals"))
def proof_id(spark, d):
    a = A.approvals(spark, d).filter(F.col("request_status") == "approved")
    return a.select(F.col("id").alias("approval_id"), lg.proof_id(F.col("id"), F.col("approval_date")).alias("proof_id"))


@register("audit_timeline", "AUD-7", oracle=with_views("""
SELECT id, entity_type, entity_id, action,
       lag(action) OVER w AS prev_action, lag(id) OVER w AS prev_id
FROM audit_logs WINDOW w AS (PARTITION BY entity_type, entity_id ORDER BY "timestamp", id)""", "audit_logs"))
def audit_timeline(spark, d):
    a = A.audit_logs(spark, d)
    t = wn.previous_in_order(a, ["entity_type", "entity_id"], ["timestamp", "id"], ["action", "id"],
                             chunk=F.date_trunc("hour", "timestamp"))
    return t.select("id", "entity_type", "entity_id", "action", "prev_action", "prev_id")


@register("audit_stream", "AUD-7", oracle=with_views("""
SELECT id, entity_type, entity_id, action, lag(action) OVER w AS prev_action, lag(id) OVER w AS prev_id, FALSE AS late
FROM audit_logs WINDOW w AS (PARTITION BY entity_type, entity_id ORDER BY "timestamp", id)""", "audit_logs"))
def audit_stream(spark, d):
    """The trail appended by a stream that is started three times, each time with the events of the next ten days."""
    events = A.audit_logs(spark, d)
    base = sk.scratch_path(spark, "audit")
    trail = au.AuditTrail(f"{base}/audit", events.schema, ["entity_type", "entity_id"], ["timestamp", "id"], ["action", "id"])
    day = F.dayofmonth("timestamp")
    for part in (day <= 10, (day > 10) & (day <= 20), day > 20):
        events.where(part).write.mode("append").parquet(f"{base}/landing")
        trail.run(f"{base}/landing", f"{base}/progress")
    return trail.timeline(spark).select("id", "entity_type", "entity_id", "action", "prev_action", "prev_id", "late")


@register("activity_counts", "AUD-8", oracle=with_views("""
SELECT action, entity_type, result_status, count(*) AS n FROM audit_logs GROUP BY ALL""", "audit_logs"))
def activity_counts(spark, d):
    return A.audit_logs(spark, d).groupBy("action", "entity_type", "result_status").agg(F.count(F.lit(1)).alias("n"))


@register("status_counts", "AGG-21", oracle=with_views("""
SELECT 'document' AS entity, status, count(*) AS n FROM ledger_documents GROUP BY ALL
UNION ALL SELECT 'query', validation_status, count(*) FROM ledger_queries GROUP BY ALL
UNION ALL SELECT 'calculation', execution_status, count(*) FROM calculations GROUP BY ALL
UNION ALL SELECT 'sanity', sanity_check_status, count(*) FROM calculations GROUP BY ALL
UNION ALL SELECT 'approval', request_status, count(*) FROM approvals GROUP BY ALL""",
    "ledger_documents", "ledger_queries", "calculations", "approvals"))
def status_counts(spark, d):
    return lg.status_counts([("document", A.ledger_documents(spark, d), "status"),
                             ("query", A.ledger_queries(spark, d), "validation_status"),
                             ("calculation", A.calculations(spark, d), "execution_status"),
                             ("sanity", A.calculations(spark, d), "sanity_check_status"),
                             ("approval", A.approvals(spark, d), "request_status")])


# ------------------------------------------------------------------ filters / limits
@register("filter_bool", "FLT-1", oracle=with_views(
    "SELECT incident_id, service FROM incidents WHERE sla_breached = TRUE", "incidents"))
def filter_bool(spark, d):
    return A.incidents(spark, d).filter(F.col("sla_breached")).select("incident_id", "service")


@register("filter_or", "FLT-2", oracle=with_views("""
SELECT l_orderkey, l_linenumber, transaction_count, supplier_id FROM billing
WHERE uptime_percent < 95 OR avg_response_time > 12 OR error_rate > 0.45 OR transaction_count < 10""", "billing"))
def filter_or(spark, d):
    b = A.billing(spark, d)
    return b.filter((F.col("uptime_percent") < 95) | (F.col("avg_response_time") > 12)
                    | (F.col("error_rate") > 0.45) | (F.col("transaction_count") < 10)).select(*LINE_KEY)


@register("filter_trailing_90d", "FLT-3", oracle=with_views(f"""
SELECT l_orderkey, l_linenumber, transaction_count, supplier_id, incident_date FROM billing
WHERE incident_date >= DATE '{AS_OF}' - INTERVAL 90 DAY""", "billing"))
def filter_trailing_90d(spark, d):
    return lg.trailing_days(A.billing(spark, d), "incident_date", AS_OF, 90).select(*LINE_KEY, "incident_date")


@register("filter_misc", ("FLT-4", "FLT-5"), oracle=with_views("""
SELECT incident_id, service, severity FROM incidents
WHERE (severity IN ('critical', 'high') AND service LIKE 'c%' AND NOT (resolution_minutes BETWEEN 300 AND 400))
   OR initial_response_minutes IS NULL OR impact_value = 1.0""", "incidents"))
def filter_misc(spark, d):
    i = A.incidents(spark, d)
    cond = ((F.col("severity").isin("critical", "high") & F.col("service").like("c%")
             & ~F.col("resolution_minutes").between(300, 400))
            | F.col("initial_response_minutes").isNull() | (F.col("impact_value") == 1.0))
    return i.filter(cond).select("incident_id", "service", "severity")


@register("active_lookup", ("FLT-6", "FLT-9"), oracle=with_views("""
SELECT u.id, u.username, count(a.id) AS approvals_signed
FROM users u LEFT JOIN approvals a ON a.approved_by = u.id AND a.request_status = 'approved'
WHERE u.is_active AND u.role = 'approver' GROUP BY u.id, u.username""", "users", "approvals"))
def active_lookup(spark, d):
    return lg.active_approvers(A.users(spark, d), A.approvals(spark, d))


@register("proof_lookup", ("FLT-6", "FLT-7"), oracle=with_views(f"""
SELECT * FROM ({CHAIN_SQL}) c WHERE approval_id = (SELECT max(id) FROM approvals WHERE request_status = 'approved')""",
    "approvals", "calculations", "ledger_queries", "ledger_documents"))
def proof_lookup(spark, d):
    """The proof of one approval, by its id."""
    wanted = A.approvals(spark, d).where("request_status = 'approved'").agg(F.max("id")).first()[0]
    return lg.search_proofs(proof_chain(spark, d), approval_id=wanted)


@register("proof_search", ("FLT-7", "LIM-3"), oracle=with_views(f"""
SELECT approval_id, calculation_id, document_id, approval_date FROM ({CHAIN_SQL}) c
WHERE document_id IN (1, 3, 5) AND approval_date >= TIMESTAMP '1995-01-01' AND approval_date < TIMESTAMP '1998-01-01'
ORDER BY approval_id LIMIT 50 OFFSET 10""", "approvals", "calculations", "ledger_queries", "ledger_documents"))
def proof_search(spark, d):
    chain = proof_chain(spark, d)
    return lg.search_proofs(chain, document_ids=[1, 3, 5], start="1995-01-01", end="1998-01-01",
                            limit=50, offset=10).select("approval_id", "calculation_id", "document_id", "approval_date")


@register("paging", "LIM-3", oracle=with_views(
    "SELECT id, calculation_id, request_status FROM approvals ORDER BY id LIMIT 50 OFFSET 100", "approvals"))
def paging(spark, d):
    return ex.page(A.approvals(spark, d), ["id"], limit=50, offset=100).select("id", "calculation_id", "request_status")


@register("sample_truncated", "LIM-1", oracle=with_views("""
SELECT l_orderkey, l_linenumber, transaction_count, supplier_id, uptime_percent,
       (SELECT count(*) FROM billing) > 1000 AS truncated
FROM billing ORDER BY l_orderkey, l_linenumber, transaction_count, supplier_id LIMIT 1000""", "billing"))
def sample_truncated(spark, d):
    b = A.billing(spark, d).select(*LINE_KEY, "uptime_percent")
    return ex.bounded_sample(b, LINE_KEY, terms.RESULT_SAMPLE_LIMIT)


@register("group_having", "AGG-17", oracle=with_views("""
SELECT service, count(*) AS incidents, round(avg(resolution_minutes), 4) AS avg_resolution,
       max(resolution_minutes) AS max_resolution, min(resolution_minutes) AS min_resolution,
       CAST(sum(resolution_minutes) AS BIGINT) AS total_resolution
FROM incidents GROUP BY service HAVING count(*) > 0""", "incidents"))
def group_having(spark, d):
    g = A.incidents(spark, d).groupBy("service").agg(
        F.count(F.lit(1)).alias("incidents"), F.round(F.avg("resolution_minutes"), 4).alias("avg_resolution"),
        F.max("resolution_minutes").alias("max_resolution"), F.min("resolution_minutes").alias("min_resolution"),
        F.sum("resolution_minutes").alias("total_resolution"))
    return g.filter(F.col("incidents") > 0)


@register("distinct_values", "AGG-18", oracle=with_views(
    "SELECT DISTINCT service, severity FROM incidents", "incidents"))
def distinct_values(spark, d):
    return A.incidents(spark, d).select("service", "severity").distinct()


@register("token_usage", "AGG-19", oracle=with_views("""
SELECT model, CAST(created_at AS DATE) AS day, count(*) AS responses, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens, min(output_tokens) AS min_output,
       max(output_tokens) AS max_output, round(avg(output_tokens), 4) AS avg_output
FROM responses GROUP BY ALL""", "responses"))
def token_usage(spark, d):
    r = A.responses(spark, d)
    return r.groupBy("model", F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("responses"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.min("output_tokens").alias("min_output"),
        F.max("output_tokens").alias("max_output"), F.round(F.avg("output_tokens"), 4).alias("avg_output"))


# ------------------------------------------------------------------ integrity
def _surplus(table, column, check, view):
    value = f"count({column}) - count(DISTINCT {column})" if check != "missing_key" else f"count(*) - count({column})"
    return f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{check}' AS \"check\", CAST({value} AS BIGINT) AS rows FROM {view}"


def _orphans(table, column, view, parent):
    return (f"SELECT '{table}', '{column}', 'orphan', CAST(count(*) AS BIGINT) FROM {view} WHERE {column} IS NOT NULL "
            f"AND {column} NOT IN (SELECT id FROM {parent} WHERE id IS NOT NULL)")


INTEGRITY_SQL = "\nUNION ALL ".join(
    [_surplus(t, "id", c, v) for t, v in (("users", "users"), ("documents", "ledger_documents"), ("queries", "ledger_queries"),
                                          ("calculations", "calculations"), ("approvals", "approvals"), ("audit_logs", "audit_logs"))
     for c in ("missing_key", "surplus_key")]
    + [_surplus("users", "username", "surplus_value", "users"), _surplus("users", "email", "surplus_value", "users"),
       _surplus("approvals", "calculation_id", "surplus_value", "approvals")]
    + [_orphans("documents", "uploaded_by", "ledger_documents", "users"), _orphans("queries", "document_id", "ledger_queries", "ledger_documents"),
       _orphans("calculations", "query_id", "calculations", "ledger_queries"), _orphans("approvals", "calculation_id", "approvals", "calculations"),
       _orphans("approvals", "approved_by", "approvals", "users"), _orphans("audit_logs", "user_id", "audit_logs", "users")]
    + [f"SELECT 'audit_logs', '{c}', 'orphan', CAST(0 AS BIGINT)" for c in ("document_id", "query_id", "calculation_id", "approval_id")])


@register("ledger_integrity", ("JN-1", "JN-3", "JN-4"), oracle=with_views(
    INTEGRITY_SQL, "users", "ledger_documents", "ledger_queries", "calculations", "approvals", "audit_logs"))
def ledger_integrity(spark, d):
    """Keys, unique values and references of the ledger's tables in their declared schemas."""
    views = {"users": A.users, "documents": A.ledger_documents, "queries": A.ledger_queries, "calculations": A.calculations,
             "approvals": A.approvals, "audit_logs": A.audit_logs}
    return sc.integrity({name: sc.conform(view(spark, d), name) for name, view in views.items()})


@register("conformed_calculations", "SNK-1", oracle=with_views("""
SELECT id, query_id, execution_status, result_rows_count, len(result_data) AS sample_rows, sanity_check_status, sanity_check_details,
       CAST(NULL AS VARCHAR) AS table_name FROM calculations""", "calculations"))
def conformed_calculations(spark, d):
    """Calculations in the declared schema: nested results as JSON, columns that are missing as nulls."""
    c = sc.conform(A.calculations(spark, d), "calculations")
    return c.select("id", "query_id", "execution_status", "result_rows_count", F.json_array_length("result_data").cast("bigint").alias("sample_rows"),
                    "sanity_check_status", "sanity_check_details", "table_name")
