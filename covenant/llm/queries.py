"""The registered queries of the training-data operators, on whole tables.

Each query applies its operator with production parameters and derives the
digest columns of its result from the operator's real output.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from covenant.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Bytes of one Arrow batch between the JVM and a Python worker, unless the session sets its own.
ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "2m")

#: Parquet's parallel range reads, unless the session sets them: each of their threads, which never end, keeps a direct buffer as large as its largest read.
RANGE_READS = ("parquet.hadoop.vectored.io.enabled", "false")


#: Python workers live on between stages: what they free goes back to the system, small arrays are still reused.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20)}


def workers_find_package(spark: SparkSession) -> None:
    """Lets Python workers import this package when it is not installed.

    Where workers share no folder with the driver, ship it with ``--py-files``.
    Batches of texts are bounded by bytes as well as by Spark's row count, and
    executors keep no buffers of earlier reads beside the workers' memory.
    """
    conf = spark.sparkContext.getConf()
    if not conf.contains(ARROW_BATCH[0]):
        spark.conf.set(*ARROW_BATCH)
    if not conf.contains(f"spark.hadoop.{RANGE_READS[0]}"):
        spark.conf.set(*RANGE_READS)
    env = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *paths])


def query(name: str, oracle: str | None = None):
    def deco(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_find_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return run
    return deco


def tokenizer_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query("op1_best_fit_pack")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from covenant.llm.packing import best_fit_pack
    return best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_path())


#: (host, path, action): the rules of the URL query's contract.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]

URL_SQL = r"""
with u as (
  select page_id, coalesce(url, '') as url, strpos(coalesce(url, ''), '://') as pos from pages
), p as (
  select page_id,
         case when pos > 0 then translate(regexp_extract(substr(url, pos + 3), '^[^/?#]*', 0),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
         case when pos > 0 then regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1, 's') else '' end as path
  from u
), r(h, p, action) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), j as (
  select page_id, host, path, (select max_by(r.h || r.p || ' ' || r.action, length(r.h || r.p)) from r
         where (host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.p)) as best from p
)
select page_id, host, path, split_part(best, ' ', 1) as rule, coalesce(split_part(best, ' ', 2), 'allow') as verdict from j
"""


@query("op2_url_filters", URL_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from covenant.llm.urls import url_verdicts
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from covenant.llm.secrets import secret_report
    return secret_report(table(spark, sf_dir, "documents"))


@query("op3_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from covenant.llm.pii import pii_report
    return pii_report(table(spark, sf_dir, "documents"))


DECONTAMINATION_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), iw as (
  select distinct item_id, least(10, len(w)) as n, w[p:p + least(10, len(w)) - 1] as win
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from i where len(w) > 0)
), dw as (
  select doc_id, n, p, w[p:p + n - 1] as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from iw) where len(w) >= n)
), hit as (
  select doc_id, p, dw.n, item_id from dw join iw on dw.n = iw.n and dw.win = iw.win
), words as (
  select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hit) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, item_id::varchar as item_id from hit) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""


@query("op9_decontamination", DECONTAMINATION_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from covenant.llm.decontaminate import contamination_report
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from covenant.llm.quality import quality_rules
    q = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


JACCARD_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
         else list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) end as s from w
), c as (
  select s, min(doc_id) as rep, len(s) as n from (select doc_id, list_sort(s) as s from s) where len(s) > 0 group by s
), g as (
  select rep, n, unnest(s) as g from c
), f as (
  select rep, n, g, row_number() over (partition by rep order by df, g) as p
  from (select rep, n, g, count(*) over (partition by g) as df from g)
), cand as (
  select distinct a.rep as a, b.rep as b, a.n as an, b.n as bn from f a join f b on a.g = b.g and a.rep < b.rep
  where 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) and 10 * (a.p - 1) <= a.n and 10 * (b.p - 1) <= b.n
), l as (
  select a, b from (select a, b, an, bn, len(list_intersect(x.s, y.s)) as o from cand join c x on x.rep = a join c y on y.rep = b)
  where 100 * o >= 90 * (an + bn - o)
), e as (
  select a as u, b as v from l union select b, a from l
), r(node, reach) as (
  select rep, rep from c union select r.node, e.v from r join e on e.u = r.reach
), comp as (
  select node as rep, min(reach) as component_id from r group by node
), docs as (
  select s.doc_id, len(s.s) as n, c.rep from s left join c on c.s = list_sort(s.s)
)
select doc_id, n::bigint as n_shingles, coalesce(component_id, doc_id) as component_id from docs left join comp using (rep)
"""


@query("op6_jaccard_join", JACCARD_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from covenant.llm.jaccard import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from covenant.llm.toxicity import toxicity
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from covenant.llm.weaklabel import quality_classifier
    return quality_classifier(table(spark, sf_dir, "documents"))


@query("op10_lm_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from covenant.llm.lm import lm_scores
    return lm_scores(table(spark, sf_dir, "documents"))


SEARCH_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), i as (
  select row_number() over () as q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), c as (
  select count(*)::bigint as n, sum(len(w))::bigint as l from d where len(w) > 0
), it as (
  select q, item_id, t, count(*)::bigint as times from (select q, item_id, unnest(w) as t from i) group by q, item_id, t
), p as (
  select r, doc_id, m, t, count(*)::bigint as tf
  from (select r, doc_id, 75 + (25 * len(w)::bigint * c.n) // c.l as m, unnest(w) as t from d, c)
  where t in (select t from it) group by r, doc_id, m, t
), f as (
  select t, floor(1000 * ln((2 * c.n + 2) / (2 * count(*) + 1)))::bigint as w from p, c group by t, c.n
), s as (
  select q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from it join f using (t) join p using (t) group by q, item_id, r, doc_id
)
select item_id, rank::integer as rank, doc_id, score
from (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from s where score > 0) where rank <= 20
"""


@query("op11_lexical_search", SEARCH_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from covenant.llm.search import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_simhash_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from covenant.llm.simhash import simhash_components
    return simhash_components(table(spark, sf_dir, "documents"))


FIM_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u,
         sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents
), g as (
  select doc_id, t, u, len(u) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
         ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
              when h4 % 100 < 50 then 'spm' else 'psm' end as form from g
), x as (
  select doc_id, t, n, form, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from c
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end as prefix_chars,
       case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                        when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else t end) as output_sha256,
       sha256(t) as restored_sha256 from x
"""


@query("op13_fill_in_middle", FIM_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from covenant.llm.fim import fill_in_middle_report
    return fill_in_middle_report(table(spark, sf_dir, "documents"))
