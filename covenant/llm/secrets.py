"""Secret scans through a trigram inverted index (native).

1. Each rule's regex gives a Boolean trigram query: literal runs of the parsed
   pattern become conjunctions of trigrams, alternatives become disjunctions.
2. The index holds, for every trigram that some query names, the texts whose
   lower-cased form contains it (texts by hash, copies once).
3. Postings are intersected per conjunction; a text that satisfies a rule's
   query is that rule's candidate, and only candidates are matched with the
   regex. A rule without mandatory trigrams scans every text.

The index only proposes: every span comes from the rule's regex on the text, so
a hash collision costs a needless check, never a wrong span.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as op
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import inner_names, small_enough, stage_table
from covenant.llm.spans import count_kind, joined, kind_spans, matches, sha256_text

#: Candidate texts (a hash and a mask, 16 bytes each) up to this count are
#: broadcast to the scan; beyond it the texts are joined by a shuffle.
BROADCAST_CANDIDATES = 500_000
#: Literal alternatives a query keeps for one run before it gives the run up.
MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """A named regex; ``group`` must have at least ``least`` characters."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, in their order. Lower limits of whole matches
#: are part of the pattern, which matches the same runs.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}+"),
    Rule("hex", r"[0-9a-f]{16,}+"),
)
#: Further well-known token forms.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("pem", r"-----BEGIN (?:[A-Z]++ )*+PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+"),
)


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Conjunction of disjunctions of trigram sets; empty if nothing is mandatory."""
    terms: list[list[frozenset[str]]] = []

    def flush(runs: list[str]) -> list[str]:
        sets = [frozenset(r[i:i + 3] for i in range(len(r) - 2)) for r in dict.fromkeys(runs)]
        if all(sets):
            terms.append(sets)
        return [""]

    def options(node) -> list[str] | None:
        """All texts an item can match, if few and known."""
        kind, arg = node
        if kind is op.LITERAL:
            return [chr(arg).lower()]
        if kind is op.IN and all(k is op.LITERAL for k, _ in arg) and len(arg) <= 8:
            return [chr(c).lower() for _, c in arg]
        if kind is op.SUBPATTERN:
            return sequence(arg[3])
        if kind is op.BRANCH:
            parts = [sequence(b) for b in arg[1]]
            return None if any(p is None for p in parts) else [s for p in parts for s in p]
        if kind in (op.MAX_REPEAT, op.POSSESSIVE_REPEAT, op.MIN_REPEAT) and arg[:2] == (0, 1) and arg[2][0][0] is op.LITERAL:
            inner = sequence(arg[2])
            return None if inner is None else ["", *inner]
        return None

    def sequence(nodes) -> list[str] | None:
        runs = [""]
        for node in nodes:
            opts = options(node)
            if opts is None or len(runs) * len(opts) > MAX_ALTERNATIVES:
                return None
            runs = [r + o for r in runs for o in opts]
        return runs

    def walk(nodes, runs: list[str]) -> list[str]:
        for node in nodes:
            opts = options(node)
            if opts is not None and len(runs) * len(opts) <= MAX_ALTERNATIVES:
                runs = [r + o for r in runs for o in opts]
                continue
            runs = flush(runs)
            if node[0] is op.SUBPATTERN:
                runs = flush(walk(node[1][3], runs))
        return runs

    flush(walk(regex_parser.parse(pattern), [""]))
    return terms


def build_index(texts: DataFrame, trigrams: Sequence[str], *, text: str = "text", text_id: str = "h") -> DataFrame:
    """Distinct postings (trigram, text id) of the given trigrams over all texts."""
    names = F.array(*[F.lit(t) for t in sorted(trigrams)])
    posted = texts.select(F.col(text_id), F.lower(text).alias("low")).select(
        text_id, F.explode(F.filter(names, lambda t: F.contains(F.col("low"), t))).alias("trigram"))
    return stage_table(posted.distinct(), "trigram-index")


def candidates(index: DataFrame, queries: dict[int, list[list[frozenset[str]]]], *, text_id: str = "h") -> DataFrame:
    """(text id, mask): bit n set where the text satisfies query n.

    ``queries`` come from the rules alone, so the table of their conjunctions
    is as small as the rule list and is broadcast.
    """
    spark = index.sparkSession
    wanted = [(q, t, c, len(clause), tri) for q, terms in queries.items() for t, term in enumerate(terms)
              for c, clause in enumerate(term) for tri in clause]
    clauses = spark.createDataFrame(wanted, "query int, term int, clause int, need int, trigram string")
    met = (index.join(F.broadcast(clauses), "trigram")
           .groupBy(text_id, "query", "term", "clause", "need").agg(F.count(F.lit(1)).alias("have")).where("have = need"))
    terms = spark.createDataFrame([(q, len(t), 1 << q) for q, t in queries.items()], "query int, terms int, bit long")
    met = (met.groupBy(text_id, "query").agg(F.count_distinct("term").alias("met"))
           .join(F.broadcast(terms), "query").where("met = terms"))
    return met.groupBy(text_id).agg(F.bit_or("bit").alias("mask"))


def rule_spans(text: Column, rule: Rule, kind: int) -> Column:
    found = matches(text, rule.pattern)
    if rule.least:
        found = F.filter(found, lambda s: F.length(F.regexp_extract(s["value"], rule.pattern, rule.group)) >= rule.least)
    return kind_spans(found, kind)


def scan_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                 rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Per input row: key, spans (array of start, kind position, end).

    Null texts are empty and have no spans; repeated rows come back as often;
    long texts are scanned whole; other columns are ignored.
    """
    if len(rules) > 63:
        raise ValueError("at most 63 rules in one scan")
    queries = {n: q for n, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    d = inner_names(docs, {key: "key", text: "text"})
    d = d.select("key", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    if queries:
        index = build_index(d, {t for q in queries.values() for term in q for c in term for t in c})
        hits = stage_table(candidates(index, queries), "secret-candidates")
        if small_enough(hits, BROADCAST_CANDIDATES):
            hits = F.broadcast(hits)
        d = d.join(hits, "h", "left")
    spans = []
    for n, rule in enumerate(rules):
        own = rule_spans(F.col("text"), rule, n)
        if n in queries:
            own = F.when(F.col("mask").bitwiseAND(1 << n) != 0, own).otherwise(F.slice(kind_spans(matches(F.lit(""), "x"), n), 1, 0))
        spans.append(own)
    return d.select(F.col("key").alias(key), F.concat(*spans).alias("spans"))


def secret_report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", more: Sequence[Rule] = MORE_RULES) -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans: counts and digests of the scan."""
    rules = (*BASE_RULES, *more)
    kinds = [r.kind for r in rules]
    s = scan_secrets(docs, key=key, text=text, rules=rules)
    base = F.filter("spans", lambda x: x["kind"] < len(BASE_RULES))
    return s.select(key, *[count_kind(F.col("spans"), n).alias(f"n_{r.kind}") for n, r in enumerate(BASE_RULES)],
                    sha256_text(joined(base, kinds)).alias("base_sha256"), joined(F.col("spans"), kinds).alias("spans"))
