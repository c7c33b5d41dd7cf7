"""Source and sink queries: every one writes under the shared checkpoint
folder and reads the written data back (SRC-1..6, SNK-1..4, streaming)."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenant.plans import adapters as A
from covenant.plans.adapters import with_views
from covenant.plans.registry import register
from covenant.sources import files as fs
from covenant.sources import sinks as sk
from covenant.sources import store as st
from covenant.streaming import penalties as sp
from covenant.plans.q_profile import _dq_sql, _statistics_sql
from covenant.plans.q_rules import RULE_CTES
from covenant.sources import runs as rn

#: The statement of the recorded run: penalties of the rows below the uptime target.
RUN_SQL = ("SELECT l_orderkey, l_linenumber, incident_date, uptime_percent, CASE WHEN uptime_percent < 98.0 THEN 1500.0 ELSE 500.0 END AS penalty, "
           "CASE WHEN error_rate > 0.4 THEN 'high' END AS note FROM billing WHERE uptime_percent < 99.0")
RUN_KINDS = [("l_orderkey", "numeric"), ("l_linenumber", "numeric"), ("incident_date", "datetime"), ("uptime_percent", "numeric"),
             ("penalty", "numeric"), ("note", "string")]
RUN_TYPES = {"l_orderkey": "bigint", "l_linenumber": "int", "incident_date": "date", "uptime_percent": "double", "penalty": "decimal(5,1)", "note": "string"}
RUN_RESULT_SQL = RUN_SQL.replace("AS penalty", "::DECIMAL(5,1) AS penalty").replace("CASE WHEN uptime", "(CASE WHEN uptime").replace("END ::", "END)::")


_RESULTS_SQL = with_views("""
SELECT 'run-1' AS run_id, metric, count(*) AS rows, round(CAST(sum(penalty) AS DOUBLE), 4) AS penalty
FROM violations GROUP BY metric""", "rule_responses", "billing_contracts", extra=RULE_CTES)


@register("csv_roundtrip", ("SRC-1", "SRC-4"), oracle=with_views("""
SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
       CAST(incident_date AS TIMESTAMP) AS incident_date, uptime_percent, avg_response_time, error_rate,
       CAST(transaction_count AS DOUBLE) AS transaction_count, CAST(supplier_id AS DOUBLE) AS supplier_id
FROM billing""", "billing"))
def csv_roundtrip(spark, d):
    path = sk.scratch_path(spark, "csv") + "/billing.csv"
    A.billing(spark, d).write.option("header", True).csv(path)
    return fs.read_data(spark, path)


@register("json_roundtrip", "SRC-3", oracle=with_views("SELECT * FROM incidents", "incidents"))
def json_roundtrip(spark, d):
    inc = A.incidents(spark, d)
    path = sk.scratch_path(spark, "json") + "/incidents.json"
    inc.write.option("timestampNTZFormat", fs.JSON_TS).json(path)
    return fs.read_data(spark, path, schema=inc.schema)


@register("parquet_scan", "SRC-2", oracle="""
SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_returnflag = 'R'""")
def parquet_scan(spark, d):
    li = fs.read_data(spark, f"{d.rstrip('/')}/lineitem.parquet")
    return li.filter((F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
                     & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_extendedprice")


@register("text_docs", "SRC-5", oracle="""
SELECT doc_id, length(text) AS n_chars, sha256(text) AS text_sha, CAST(strlen(text) AS BIGINT) AS file_size
FROM documents""")
def text_docs(spark, d):
    """Documents written to and read from bulk text files."""
    path = sk.scratch_path(spark, "docs")
    fs.write_documents(A.table(spark, d, "documents"), path, "doc_id", "text")
    docs = fs.read_bulk_documents(spark, path)
    return docs.select(F.col("filename").cast("bigint").alias("doc_id"), F.length("text_content").cast("bigint").alias("n_chars"),
                       F.sha2("text_content", 256).alias("text_sha"), "file_size")


@register("file_profile", "SRC-8", oracle="""
SELECT 'customer.csv' AS file_name, TRUE AS has_size, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS headers,
       'float,string,float,float,string' AS column_types, count(*) AS total_rows, CAST(least(count(*), 90) AS INTEGER) AS row_count,
       (SELECT string_agg(CAST(c_custkey AS VARCHAR) || c_name, ',' ORDER BY c_custkey) FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 90) x) AS sample_keys
FROM customer""")
def file_profile(spark, d):
    """The profile of the customers as a CSV file: size, columns, row count and the first rows."""
    path = sk.scratch_path(spark, "profile") + "/customer.csv"
    A.table(spark, d, "customer").write.option("header", True).csv(path)
    p = fs.file_profile(spark, path, ["c_custkey"])
    key = lambda j: F.concat(F.get_json_object(j, "$.c_custkey").cast("double").cast("bigint").cast("string"), F.get_json_object(j, "$.c_name"))
    return p.select("file_name", (F.col("file_size") > 0).alias("has_size"), F.array_join("headers", ",").alias("headers"),
                    F.array_join("column_types", ",").alias("column_types"), "total_rows", "row_count",
                    F.array_join(F.transform("sample_data", key), ",").alias("sample_keys"))


CACHE_RECORDS_SQL = """
SELECT sha256(u.text) AS cache_key, a.text AS content, CAST(length(u.text) AS BIGINT) AS input_tokens,
       CAST(length(a.text) AS BIGINT) AS output_tokens, u.conv_id, u.turn
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'"""


def cache_records(spark, d):
    """A response record per question: its key, the answer, sizes, and when (conversation, turn)."""
    c = A.table(spark, d, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("content"))
    return u.join(a, ["conv_id", "turn"]).select(
        F.sha2("prompt", 256).alias("cache_key"), "content", F.length("prompt").cast("bigint").alias("input_tokens"),
        F.length("content").cast("bigint").alias("output_tokens"), "conv_id", "turn")


@register("cache_scan", "SRC-6", oracle=f"SELECT cache_key, content, input_tokens, output_tokens FROM ({CACHE_RECORDS_SQL}) r")
def cache_scan(spark, d):
    rec = cache_records(spark, d).select(
        "cache_key", "content", F.lit("").alias("thinking"), F.struct("input_tokens", "output_tokens").alias("usage"),
        F.lit("conversation-model").alias("model"), F.lit(True).alias("cached"),
        F.lit("2024-01-01T00:00:00").alias("timestamp"))
    path = sk.scratch_path(spark, "cache")
    rec.write.json(path)
    back = fs.read_response_cache(spark, path, lines=True)
    return back.select(F.col("cache_key"), "content", F.col("usage.input_tokens").alias("input_tokens"),
                       F.col("usage.output_tokens").alias("output_tokens"))


def recorded_run(spark, d, sql=RUN_SQL, run_id="run-1", base=None):
    base = base or sk.scratch_path(spark, "runs")
    return rn.run_record(spark, sql, A.billing(spark, d), "billing", run_id=run_id, results=f"{base}/results", ledger=f"{base}/ledger",
                         query_id="penalties", source_file="lineitem.parquet", order=["l_orderkey", "l_linenumber", "uptime_percent"], sample_limit=100)


@register("ledger_append", "SNK-1", oracle=with_views(f"""
SELECT 'run-1' AS run_id, 'penalties' AS query_id, 'success' AS execution_status, 'billing' AS table_name, 'lineitem.parquet' AS source_file,
       count(*) AS rows_count, '{",".join(c for c, _ in RUN_KINDS)}' AS columns, '{",".join(RUN_TYPES.values())}' AS column_types,
       '0,0,0,0,0,' || count(*) FILTER (WHERE note IS NULL) AS null_counts,
       CAST(least(count(*), 100) AS INTEGER) AS sample_rows, count(*) > 100 AS sample_truncated, 100 AS sample_limit,
       CASE WHEN count(*) FILTER (WHERE note IS NULL) > 0.5 * count(*) THEN 'warning' ELSE 'passed' END AS sanity_check_status,
       (SELECT count(*) FROM billing) AS input_rows, 8 AS input_columns, count(*) AS output_rows, 6 AS output_columns
FROM run_result""", "billing", extra={"run_result": RUN_RESULT_SQL}))
def ledger_append(spark, d):
    """One statement run over the billing table, as one run record."""
    text = lambda c: F.array_join(c, ",").alias(c)
    return recorded_run(spark, d).select(
        "run_id", "query_id", "execution_status", "table_name", "source_file", "rows_count", text("columns"), text("column_types"), text("null_counts"),
        F.size("sample_data").alias("sample_rows"), "sample_truncated", "sample_limit", "sanity_check_status",
        "input_rows", "input_columns", "output_rows", "output_columns")


@register("run_statistics", ("SNK-1", "AGG-5"), oracle=with_views(_statistics_sql("run_result", RUN_KINDS, RUN_TYPES), "billing",
                                                                  extra={"run_result": RUN_RESULT_SQL}))
def run_statistics(spark, d):
    """The statistics table of the run record."""
    return recorded_run(spark, d).select(F.inline("statistics"))


@register("run_checks", ("SNK-1", "DQ-10"), oracle=with_views(
    "SELECT column_name, \"check\", severity, value, detail FROM (" + _dq_sql("run", "run_result", RUN_KINDS) + ") q", "billing", extra={"run_result": RUN_RESULT_SQL}))
def run_checks(spark, d):
    """The sanity checks of the run record."""
    return recorded_run(spark, d).select(F.inline("sanity_checks"))


@register("results_write", "SNK-2", oracle=_RESULTS_SQL)
def results_write(spark, d):
    from covenant.plans.q_rules import rule_eval
    back = sk.write_results(rule_eval(spark, d), sk.scratch_path(spark, "results"), "run-1")
    return back.groupBy("run_id", "metric").agg(F.count(F.lit(1)).alias("rows"),
                                               F.round(F.sum("penalty"), 4).alias("penalty"))


def filled_store(spark, d):
    """The response store after two upserts: the first turns, then all later ones."""
    r = cache_records(spark, d)
    store = st.RecordStore(sk.scratch_path(spark, "store"), r.schema, ("cache_key",), ("conv_id", "turn"))
    store.upsert(r.where("turn < 2"))
    store.upsert(r.where("turn >= 2"))
    return store


STORED_SQL = f"""
SELECT cache_key, arg_max(content, (conv_id, turn)) AS content, arg_max(input_tokens, (conv_id, turn)) AS input_tokens,
       arg_max(output_tokens, (conv_id, turn)) AS output_tokens, arg_max(conv_id, (conv_id, turn)) AS conv_id, arg_max(turn, (conv_id, turn)) AS turn
FROM ({CACHE_RECORDS_SQL}) r GROUP BY cache_key"""


@register("cache_upsert", "SNK-3", oracle=STORED_SQL)
def cache_upsert(spark, d):
    return filled_store(spark, d).read(spark)


@register("cache_lookup", ("FLT-6", "SRC-6"), oracle=f"SELECT * FROM ({STORED_SQL}) s WHERE cache_key = (SELECT min(cache_key) FROM ({STORED_SQL}) k)")
def cache_lookup(spark, d):
    """One record by its key, from the one bucket that can hold it."""
    return filled_store(spark, d).lookup(cache_records(spark, d).agg(F.min("cache_key").alias("cache_key")))


@register("json_rows", "SNK-4", oracle=with_views("""
SELECT CAST(json_object('incident_id', incident_id, 'service', service, 'severity', severity,
       'detected_at', strftime(detected_at, '%Y-%m-%dT%H:%M:%S.%f'), 'initial_response_minutes', initial_response_minutes,
       'resolution_minutes', resolution_minutes, 'resolved_at', strftime(resolved_at, '%Y-%m-%dT%H:%M:%S.%f'), 'impact_value', impact_value,
       'sla_breached', sla_breached, 'tenant_id', tenant_id) AS VARCHAR) AS json
FROM incidents""", "incidents"))
def json_rows(spark, d):
    return sk.json_rows(A.incidents(spark, d))


@register("stream_row_penalty", ("RUL-5",), oracle=with_views("""
SELECT l_orderkey, l_linenumber, transaction_count, supplier_id,
       CAST(CASE WHEN uptime_percent < 95.0 THEN 2500.0 WHEN uptime_percent < 98.0 THEN 1500.0
             WHEN uptime_percent < 98.9 THEN 1000.0 WHEN uptime_percent < 99.0 THEN 500.0 ELSE 0.0 END AS DOUBLE)
     + CAST(CASE WHEN avg_response_time > 10.0 THEN 1000.0 WHEN avg_response_time > 5.0 THEN 500.0
             WHEN avg_response_time > 2.0 THEN 200.0 ELSE 0.0 END AS DOUBLE) AS total_penalty
FROM billing""", "billing"))
def stream_row_penalty(spark, d):
    base = sk.scratch_path(spark, "stream")
    schema = spark.read.parquet(f"{d.rstrip('/')}/lineitem.parquet").schema
    sp.run_to_ledger(spark, d, schema, base + "/ledger", base + "/_checkpoint", glob="lineitem.parquet")
    return spark.read.parquet(base + "/ledger").select("l_orderkey", "l_linenumber", "transaction_count",
                                                       "supplier_id", "total_penalty")
