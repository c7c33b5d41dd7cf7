"""Text-table queries: prompts, cache split, responses, SQL lint, completeness
(TXT-*, JN-6, SET-2..4, SRC-7/8, EXT-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenant import terms
from covenant.functions.columns import sql_list
from covenant.operators import sqltext as st
from covenant.operators import text as tx
from covenant.operators.ledger import registry_frame
from covenant.plans import adapters as A
from covenant.plans.adapters import with_views
from covenant.plans.registry import register
from covenant.sources import files as fs

GENERIC = next(t for t in terms.DOCUMENT_TYPES if t[0] == terms.GENERIC_TYPE)


def docs_in(spark, d):
    doc = A.table(spark, d, "documents")
    return doc.select(
        "doc_id", "text", "lang", "source",
        F.when(F.col("lang") == "en", "sla").when(F.col("lang") == "de", "Insurance")
         .when(F.col("lang") == "fr", "service_agreement").otherwise("lease").alias("document_type"),
        F.when(F.col("source") == "src1", "   ").when(F.col("source") == "src2", "List every number in the document.")
         .alias("custom_prompt"),
        F.when(F.col("source") == "src0", "Focus on penalties and credits.").alias("custom_instructions"))


DOCS_SQL = """
SELECT doc_id, text, lang, source,
       CASE WHEN lang = 'en' THEN 'sla' WHEN lang = 'de' THEN 'Insurance' WHEN lang = 'fr' THEN 'service_agreement'
            ELSE 'lease' END AS document_type,
       CASE WHEN source = 'src1' THEN '   ' WHEN source = 'src2' THEN 'List every number in the document.' END
         AS custom_prompt,
       CASE WHEN source = 'src0' THEN 'Focus on penalties and credits.' END AS custom_instructions
FROM documents"""
REG_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', '{dsc}', '{', '.join(k)}')" for n, dsc, k in terms.DOCUMENT_TYPES) + ") r(name, description, outputs)"
PROMPTS_SQL = f"""
SELECT doc_id, resolved_type, prompt_source, prompt,
       'You analyse documents of this kind: ' || type_description || '. Answer with JSON only.' AS system
FROM (SELECT *, base || chr(10) || chr(10)
                || CASE WHEN coalesce(custom_instructions, '') <> '' THEN 'Additional Instructions: ' || custom_instructions
                        ELSE '' END
                || chr(10) || chr(10) || '---' || chr(10) || 'Document to Analyze:' || chr(10) || text
                || chr(10) || chr(10) || 'Reply with the JSON object described above.' AS prompt
      FROM (SELECT d.*, coalesce(r.name, '{GENERIC[0]}') AS resolved_type,
                   coalesce(r.description, '{GENERIC[1]}') AS type_description,
                   coalesce(CASE WHEN trim(custom_prompt) <> '' THEN custom_prompt END,
                            'Extract the terms of this ' || coalesce(r.description, '{GENERIC[1]}')
                            || ' and return one JSON object with the keys: '
                            || coalesce(r.outputs, '{', '.join(GENERIC[2])}') || '.') AS base,
                   CASE WHEN trim(custom_prompt) <> '' THEN 'custom'
                        WHEN lower(d.document_type) = coalesce(r.name, '{GENERIC[0]}') THEN 'type'
                        ELSE 'generic' END AS prompt_source
            FROM docs d LEFT JOIN reg r ON r.name = lower(d.document_type)) a) b"""
PROMPT_CTES = {"docs": DOCS_SQL, "reg": REG_SQL, "prompts": PROMPTS_SQL}


def prompts(spark, d):
    return tx.prompt_table(docs_in(spark, d), "document_type", "text", "custom_prompt", "custom_instructions")


@register("prompt_table", ("TXT-1", "EXT-3"), oracle=with_views("""
SELECT doc_id, resolved_type, length(prompt) AS prompt_chars, sha256(system || '||' || prompt) AS prompt_key
FROM prompts""", extra=PROMPT_CTES))
def prompt_table(spark, d):
    p = prompts(spark, d)
    return p.select("doc_id", "resolved_type", F.length("prompt").cast("bigint").alias("prompt_chars"),
                    tx.prompt_key(F.col("system"), F.col("prompt")).alias("prompt_key"))


@register("prompt_choice", "TXT-2", oracle=with_views(
    "SELECT doc_id, prompt_source, sha256(prompt) AS prompt_hash FROM prompts", extra=PROMPT_CTES))
def prompt_choice(spark, d):
    return prompts(spark, d).select("doc_id", "prompt_source", F.sha2("prompt", 256).alias("prompt_hash"))


# ---------------------------------------------------------------- conversations
CONV_PROMPTS_SQL = """
SELECT u.conv_id, u.turn, u.text, s.system,
       sha256(coalesce(s.system, '') || '||' || u.text) AS prompt_key
FROM conversations u
LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id) s
  ON s.conv_id = u.conv_id
WHERE u.role = 'user'"""
CACHE_SQL = """
SELECT DISTINCT p.prompt_key FROM conv_prompts p
WHERE EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = p.conv_id AND a.turn = p.turn + 1 AND a.role = 'assistant')"""


def conv_prompts(spark, d):
    c = A.table(spark, d, "conversations")
    system = (c.filter(F.col("role") == "system").groupBy("conv_id")
              .agg(F.min_by("text", "turn").alias("system")))
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", "text")
    p = u.join(system, "conv_id", "left")
    return p.withColumn("prompt_key", tx.prompt_key(F.col("system"), F.col("text")))


def cache_keys(spark, d):
    c = A.table(spark, d, "conversations")
    answered = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return conv_prompts(spark, d).join(answered, ["conv_id", "turn"], "left_semi").select("prompt_key")


@register("prompt_key", "TXT-4", oracle="SELECT conv_id, turn, prompt_key FROM (" + CONV_PROMPTS_SQL + ") p")
def prompt_key(spark, d):
    return conv_prompts(spark, d).select("conv_id", "turn", "prompt_key")


@register("prompt_dedupe", "TXT-5", oracle=f"""
SELECT prompt_key, count(*) AS copies, min(conv_id * 1000000 + turn) AS first_at
FROM ({CONV_PROMPTS_SQL}) p GROUP BY prompt_key""")
def prompt_dedupe(spark, d):
    g = tx.dedupe_prompts(conv_prompts(spark, d), "prompt_key", ["conv_id", "turn"])
    return g.select("prompt_key", "copies",
                    (F.col("first.conv_id") * 1000000 + F.col("first.turn")).alias("first_at"))


@register("cache_split", "JN-6", oracle=with_views("""
SELECT conv_id, turn, prompt_key, CASE WHEN prompt_key IN (SELECT prompt_key FROM cache) THEN 'hit' ELSE 'miss' END
       AS status
FROM conv_prompts""", extra={"conv_prompts": CONV_PROMPTS_SQL, "cache": CACHE_SQL}))
def cache_split(spark, d):
    s = tx.split_cache(conv_prompts(spark, d), cache_keys(spark, d))
    return s.select("conv_id", "turn", "prompt_key", "status")


# ---------------------------------------------------------------- responses
STATUS_SQL = """
CASE WHEN content IS NULL OR content = '' THEN 'empty'
     WHEN json_valid(content) THEN 'direct'
     WHEN regexp_extract(content, '(?s)(\\{.*\\})', 1) <> '' AND json_valid(regexp_extract(content, '(?s)(\\{.*\\})', 1))
       THEN 'extracted'
     ELSE 'unparseable' END"""
BODY_SQL = """
CASE WHEN content <> '' AND json_valid(content) THEN content
     WHEN regexp_extract(content, '(?s)(\\{.*\\})', 1) <> '' AND json_valid(regexp_extract(content, '(?s)(\\{.*\\})', 1))
       THEN regexp_extract(content, '(?s)(\\{.*\\})', 1) END"""


@register("response_json", "TXT-6", oracle=with_views(f"""
SELECT response_id, {STATUS_SQL} AS status,
       CAST(json_extract_string({BODY_SQL}, '$.k') AS BIGINT) AS k
FROM responses""", "responses"))
def response_json(spark, d):
    r = A.responses(spark, d)
    body = tx.json_body(F.col("content"))
    return r.select("response_id", tx.json_status(F.col("content")).alias("status"),
                    F.get_json_object(body, "$.k").cast("bigint").alias("k"))


@register("response_errors", "TXT-7", oracle=with_views(f"""
SELECT error_type, count(*) AS responses FROM (
  SELECT CASE WHEN suffix(model, '-error') THEN 'llm_error'
              WHEN {STATUS_SQL} = 'empty' THEN 'extraction_error'
              WHEN {STATUS_SQL} = 'unparseable' THEN 'json_extraction_error' END AS error_type
  FROM responses) e
WHERE error_type IS NOT NULL GROUP BY error_type""", "responses"))
def response_errors(spark, d):
    r = A.responses(spark, d)
    e = r.select(tx.error_type(tx.json_status(F.col("content")), F.col("model"), F.col("content")).alias("error_type"))
    return e.filter(F.col("error_type").isNotNull()).groupBy("error_type").agg(F.count(F.lit(1)).alias("responses"))


@register("response_previews", "TXT-7", oracle=with_views(f"""
SELECT response_id, {STATUS_SQL} AS status, substr(content, 1, {terms.RESPONSE_PREVIEW_CHARS}) AS response_preview
FROM responses WHERE {STATUS_SQL} IN ('empty', 'unparseable')
UNION ALL
SELECT doc_id, 'unparseable', substr(text, 1, {terms.RESPONSE_PREVIEW_CHARS}) FROM documents
WHERE text <> '' AND ({STATUS_SQL.replace("content", "text")}) = 'unparseable'""", "responses"))
def response_previews(spark, d):
    """The beginnings of responses without JSON: of the response log, and of the documents taken as responses."""
    r = A.responses(spark, d).select("response_id", "content")
    docs = A.text_table(spark, d, "documents").where("text <> ''").select(F.col("doc_id").alias("response_id"), F.col("text").alias("content"))
    pick = lambda df, *kinds: df.select("response_id", tx.json_status(F.col("content")).alias("status"),
                                        tx.preview(F.col("content")).alias("response_preview")).where(F.col("status").isin(*kinds))
    return pick(r, "empty", "unparseable").unionByName(pick(docs, "unparseable"))


@register("query_default", "TXT-8", oracle=with_views(f"""
SELECT 'terms' AS source, contract_id AS response_id,
       coalesce(nullif(json_extract_string(content, '$.sql_query'), ''), 'SELECT * FROM billing') AS query_text
FROM rule_responses
UNION ALL
SELECT 'responses', response_id,
       coalesce(nullif(json_extract_string({BODY_SQL}, '$.sql_query'), ''), 'SELECT * FROM billing')
FROM responses""", "rule_responses", "responses"))
def query_default(spark, d):
    default = F.lit("SELECT * FROM billing")
    t = A.rule_responses(spark, d).select(
        F.lit("terms").alias("source"), F.col("contract_id").alias("response_id"),
        F.coalesce(F.nullif(F.get_json_object("content", "$.sql_query"), F.lit("")), default).alias("query_text"))
    r = A.responses(spark, d).select(
        F.lit("responses").alias("source"), "response_id",
        F.coalesce(F.nullif(F.get_json_object(tx.json_body(F.col("content")), "$.sql_query"), F.lit("")), default)
        .alias("query_text"))
    return t.unionByName(r)


def _kw(words):
    return "[" + sql_list(w.upper() for w in words) + "]"


COLS_UP = _kw(A.QUERY_LOG_COLUMNS)


@register("sql_lint_words", ("TXT-9", "SET-3"), oracle=with_views(f"""
SELECT query_id, array_to_string(bad, ',') AS invalid_identifiers, len(bad) = 0 AS valid
FROM (SELECT query_id,
             list_sort(list_filter(list_distinct(regexp_extract_all(sql_text, '{terms.LINT_WORD_PATTERN}', 1)),
                       lambda x: NOT list_contains({_kw(terms.LINT_KEYWORDS_WORDS)}, upper(x))
                            AND NOT list_contains({COLS_UP}, upper(x)))) AS bad
      FROM query_log) q""", "query_log"))
def sql_lint_words(spark, d):
    q = A.query_log(spark, d)
    bad = tx.lint_words(F.col("sql_text"), A.QUERY_LOG_COLUMNS)
    return q.select("query_id", F.concat_ws(",", bad).alias("invalid_identifiers"), (F.size(bad) == 0).alias("valid"))


@register("sql_lint_position", ("TXT-10", "SET-2"), oracle=with_views(f"""
SELECT query_id, array_to_string(missing, ',') AS missing_columns, len(missing) = 0 AS valid
FROM (SELECT query_id,
             list_sort(list_filter(list_distinct(regexp_extract_all(upper(sql_text),
                                                                    '{terms.LINT_POSITION_PATTERN}', 1)),
                       lambda x: NOT list_contains({_kw(terms.LINT_KEYWORDS_POSITION)}, x)
                            AND NOT list_contains({COLS_UP}, x))) AS missing
      FROM query_log) q""", "query_log"))
def sql_lint_position(spark, d):
    q = A.query_log(spark, d)
    miss = tx.lint_position(F.col("sql_text"), A.QUERY_LOG_COLUMNS)
    return q.select("query_id", F.concat_ws(",", miss).alias("missing_columns"), (F.size(miss) == 0).alias("valid"))


@register("sql_lint_strict", "TXT-9", oracle="""
SELECT event_id AS query_id,
       CASE event_type WHEN 'click' THEN 'qualifier X' WHEN 'purchase' THEN 'column USER_' || user_id
                       WHEN 'error' THEN 'column GHOST,table ARCHIVE_' || user_id ELSE '' END AS findings,
       event_type IN ('view', 'signup') AS valid
FROM events""")
def sql_lint_strict(spark, d):
    """Names that neither the schema nor the statement itself knows; nothing inside literals or comments."""
    q = A.statement_log(spark, d)
    bad = st.lint_names(F.col("sql_text"), A.QUERY_LOG_COLUMNS, ["events"])
    return q.select("query_id", bad.alias("bad")).select("query_id", F.concat_ws(",", "bad").alias("findings"), (F.size("bad") == 0).alias("valid"))


BILLING_COLUMNS = ["l_orderkey", "l_linenumber", "incident_date", "uptime_percent", "avg_response_time",
                   "error_rate", "transaction_count", "supplier_id"]


@register("required_fields", "TXT-11", oracle=with_views(f"""
SELECT contract_id, array_to_string(missing, ',') AS missing_fields, len(missing) = 0 AS complete
FROM (SELECT contract_id,
             list_sort(list_filter(CAST(json_extract(content, '$.data_fields_required') AS VARCHAR[]),
                                   lambda x: NOT list_contains([{sql_list(BILLING_COLUMNS)}], x))) AS missing
      FROM rule_responses) r""", "rule_responses"))
def required_fields(spark, d):
    from covenant.operators.rules import parse_terms
    t = parse_terms(A.rule_responses(spark, d))
    miss = tx.missing_items(F.col("terms.data_fields_required"), BILLING_COLUMNS)
    return t.select("contract_id", F.concat_ws(",", miss).alias("missing_fields"), (F.size(miss) == 0).alias("complete"))


def _completeness_sql(source: str, keys: list[str], response_id: str, body: str, table: str) -> str:
    return (f"SELECT '{source}' AS source, {response_id} AS response_id, {len(keys)} AS n_expected, "
            f"list_sort(list_filter([{sql_list(keys)}], lambda x: NOT list_contains(coalesce(json_keys({body}), []), x))) AS missing FROM {table}")


@register("completeness", ("TXT-12", "SET-4"), oracle=with_views(f"""
SELECT source, response_id, array_to_string(missing, ',') AS missing_outputs,
       round(1 - len(missing) / n_expected, 4) AS completeness
FROM ({" UNION ALL ".join(_completeness_sql(n, k, "contract_id", "content", "rule_responses") for n, _d, k in terms.DOCUMENT_TYPES)}
      UNION ALL {_completeness_sql("responses", GENERIC[2], "response_id", "body", f"(SELECT response_id, {BODY_SQL} AS body FROM responses) b")}) m""",
    "rule_responses", "responses"))
def completeness(spark, d):
    """Term responses against every document type's keys, and all other
    responses against the generic ones; without a JSON body all are missing."""
    def missing(expected, body):
        exp = F.array(*[F.lit(x) for x in expected])
        return F.array_sort(F.coalesce(F.array_except(exp, F.json_object_keys(body)), exp))
    t = A.rule_responses(spark, d)
    checks = F.array(*[F.struct(F.lit(n).alias("source"), missing(k, F.col("content")).alias("m"), F.lit(len(k)).alias("n"))
                       for n, _d, k in terms.DOCUMENT_TYPES])
    t = t.select(F.col("contract_id").alias("response_id"), F.explode(checks).alias("c")).select("c.source", "response_id", "c.m", "c.n")
    r = (A.responses(spark, d).select("response_id", tx.json_body(F.col("content")).alias("body"))
         .select(F.lit("responses").alias("source"), "response_id", missing(GENERIC[2], F.col("body")).alias("m"),
                 F.lit(len(GENERIC[2])).alias("n")))
    return t.unionByName(r).select("source", "response_id", F.concat_ws(",", "m").alias("missing_outputs"),
                                   F.round(1 - F.size("m") / F.col("n"), 4).alias("completeness"))


# ---------------------------------------------------------------- names / schemas / registry
FILE_NAME_SQL = ("CAST(c_custkey AS VARCHAR) || '_' || CAST(c_nationkey AS VARCHAR) || '.5_' || c_name || "
                 "CASE WHEN c_acctbal < 0 THEN '-Late Fees.CSV' ELSE ' billing data.csv' END")


@register("table_names", "SRC-7", oracle=f"""
SELECT c_custkey, file_name,
       translate(lower(CASE WHEN contains(b, '.') THEN regexp_replace(b, '\\.[^.]*$', '') ELSE b END), '- ', '__')
         AS table_name
FROM (SELECT c_custkey, file_name, regexp_replace(file_name, '^\\d+_\\d+(\\.\\d+)?_', '') AS b
      FROM (SELECT c_custkey, {FILE_NAME_SQL} AS file_name FROM customer) f) x""")
def table_names(spark, d):
    c = A.table(spark, d, "customer")
    name = F.concat(F.col("c_custkey").cast("string"), F.lit("_"), F.col("c_nationkey").cast("string"),
                    F.lit(".5_"), F.col("c_name"),
                    F.when(F.col("c_acctbal") < 0, F.lit("-Late Fees.CSV")).otherwise(F.lit(" billing data.csv")))
    return fs.with_table_names(c.select("c_custkey", name.alias("file_name")), "file_name")


PROFILE_TABLES = [("customer", "c_custkey", [("c_custkey", "integer"), ("c_name", None), ("c_nationkey", "integer"),
                                              ("c_acctbal", "float"), ("c_mktsegment", None)]),
                  ("orders", "o_orderkey", [("o_orderkey", "integer"), ("o_custkey", "integer"),
                                            ("o_orderstatus", None), ("o_totalprice", "float"),
                                            ("o_orderdate", "date"), ("o_orderpriority", None)]),
                  ("events", "event_id", [("event_id", "integer"), ("ts", "date"), ("user_id", "integer"),
                                          ("event_type", None), ("value", "float"), ("props", None)])]


def _label_sql(v):
    from covenant.plans.q_profile import _label_sql as lab
    return lab(v)


def _schema_profile_sql():
    parts = []
    for t, key, cols in PROFILE_TABLES:
        for i, (c, lab) in enumerate(cols):
            s = f"arg_min(CAST({c} AS VARCHAR), {key}) FILTER (WHERE {c} IS NOT NULL)"
            label = f"'{lab}'" if lab else f"coalesce({_label_sql(s)}, 'string')"
            parts.append(f"SELECT '{t}' AS table_name, {i + 1} AS position, '{c}' AS column_name, {label} AS type_label, "
                         f"{s} AS sample, count({c}) AS non_null, count(*) AS total_rows FROM {t}")
    return "\nUNION ALL ".join(parts)


def profiles(spark, d):
    return fs.profile_tables(spark, [(t, A.table(spark, d, t), key) for t, key, _ in PROFILE_TABLES])


@register("schema_profile", "SRC-8", oracle=_schema_profile_sql())
def schema_profile(spark, d):
    return profiles(spark, d)


SCHEMA_TEXT_SQL = f"""
SELECT table_name, 'Table Name: `' || table_name || '`' || chr(10) || 'Total Columns: ' || CAST(count(*) AS VARCHAR)
       || chr(10) || string_agg(CAST(position AS VARCHAR) || '. `' || column_name || '` (' || type_label || ') = '
                                || coalesce(sample, 'NULL'), chr(10) ORDER BY position) AS schema_text
FROM ({_schema_profile_sql()}) p GROUP BY table_name"""


@register("schema_text", "TXT-3", oracle=SCHEMA_TEXT_SQL)
def schema_text(spark, d):
    return fs.schema_text(profiles(spark, d))


DATA_TABLE_SQL = "CASE WHEN lang = 'en' THEN 'customer' WHEN lang = 'de' THEN 'orders' WHEN lang = 'fr' THEN 'no such table' END"


@register("prompt_schema", ("TXT-1", "TXT-3"), oracle=with_views(f"""
SELECT p.doc_id, length(p.prompt || coalesce(chr(10) || s.schema_text, '')) AS prompt_chars,
       sha256(p.prompt || coalesce(chr(10) || s.schema_text, '')) AS prompt_hash
FROM (SELECT prompts.doc_id, prompt, {DATA_TABLE_SQL} AS data_table FROM prompts JOIN docs USING (doc_id)) p
LEFT JOIN ({SCHEMA_TEXT_SQL}) s ON s.table_name = p.data_table""", extra=PROMPT_CTES))
def prompt_schema(spark, d):
    """Prompts that end with the schema of the document's data table, where it has one."""
    docs = docs_in(spark, d).withColumn("data_table", F.when(F.col("lang") == "en", "customer").when(F.col("lang") == "de", "orders")
                                        .when(F.col("lang") == "fr", "no such table"))
    p = tx.prompt_table(docs, "document_type", "text", "custom_prompt", "custom_instructions", fs.schema_text(profiles(spark, d)), "data_table")
    return p.select("doc_id", F.length("prompt").cast("bigint").alias("prompt_chars"), F.sha2("prompt", 256).alias("prompt_hash"))


@register("registry_override", "EXT-1", oracle=with_views(f"""
SELECT name, arg_max(description, registered_at) AS description, arg_max(n_outputs, registered_at) AS n_outputs,
       max(registered_at) AS version
FROM (SELECT name, description, len(string_split(outputs, ', ')) AS n_outputs, 0 AS registered_at FROM reg
      UNION ALL
      SELECT DISTINCT lower(document_type), 'Registered from uploads', {len(GENERIC[2])}, 1 FROM docs) u
GROUP BY name""", extra={"reg": REG_SQL, "docs": DOCS_SQL}))
def registry_override(spark, d):
    base = registry_frame(spark).withColumn("registered_at", F.lit(0))
    new = (docs_in(spark, d).select(F.lower("document_type").alias("name")).distinct()
           .select("name", F.lit("Registered from uploads").alias("description"),
                   F.array(*[F.lit(x) for x in GENERIC[2]]).alias("expected_outputs"),
                   F.lit(1).alias("registered_at")))
    u = base.unionByName(new)
    g = u.groupBy("name").agg(F.max_by(F.struct("description", "expected_outputs"), "registered_at").alias("r"),
                              F.max("registered_at").alias("version"))
    return g.select("name", F.col("r.description").alias("description"),
                    F.size("r.expected_outputs").cast("bigint").alias("n_outputs"), "version")


@register("prompt_usage", "EXT-2", oracle=with_views("""
SELECT substr(sha256(custom_prompt), 1, 12) AS prompt_id, count(*) AS usage_count, length(custom_prompt) AS prompt_chars
FROM docs WHERE trim(custom_prompt) <> '' GROUP BY custom_prompt""", extra={"docs": DOCS_SQL}))
def prompt_usage(spark, d):
    dd = docs_in(spark, d).filter(F.trim("custom_prompt") != "")
    return dd.groupBy("custom_prompt").agg(F.count(F.lit(1)).alias("usage_count")).select(
        F.substring(F.sha2("custom_prompt", 256), 1, 12).alias("prompt_id"), "usage_count",
        F.length("custom_prompt").cast("bigint").alias("prompt_chars"))
