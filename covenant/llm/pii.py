"""Personal data: exact base kinds plus information-theoretic sanitisation (native).

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone
numbers. Beyond them, words can give such an entity away. Terms and units are
counted over whole documents, in different texts; a unit is the exact value, a
group that recurs (e-mail domain, phone, network and card prefix), or the kind.
With N texts,

    IC(u)      = log2(N / docs(u))                                  information of unit u
    disclosure = log2(low(docs(t, u) / docs(t)) * N / docs(u)) / IC(u)

where low is the lower confidence bound of P(u | t): 1 means that whoever reads t
knows u. As IC grows with the corpus, a high disclosure alone is no evidence: the
word must also stand with u more often than chance allows. By chance a text holds
an entity of any kind with the base rate r, so

    P(docs(t, u) of docs(t) or more) <= exp(-docs(t) * KL(docs(t, u) / docs(t) || r))

must be at most ``alpha`` divided by the number of pairs that meet in texts
(Bonferroni). The texts that this takes depend on r and, through the number of
pairs, on the logarithm of the corpus only: words of a few texts are no evidence
in any corpus. A flagged word is marked in all documents, wherever it stands: from ``remove_at`` on it is
removed, below it generalised.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import inner_names, stage_table, temporary_tables
from covenant.llm.spans import count_kind, joined, let, matches, sha256_text

KINDS = ("email", "ip", "card", "phone", "term")
BASE_KINDS = KINDS[:4]
TERM = 4

#: The base patterns. Possessive and anchored to the start of a
#: run (or the end of the last match), which matches the same spans as the plain
#: forms without rescanning a long run from each of its characters.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    r"[0-9](?:[\x20-]?+[0-9]){11,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: A plain character that every match of the kind holds, to skip texts by.
NEEDS = ("@", ".", None, "+")
PLACEHOLDERS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[WORD]")

WORD = r"[\p{L}\p{N}]++"
THRESHOLD = 0.8
REMOVE_AT = 0.95
#: One-sided 95 % confidence of P(unit | term), and the chance of flagging any word without cause.
CONFIDENCE = 1.645
ALPHA = 0.05

#: Bytes of a side up to which it is broadcast; beyond them the same joins shuffle.
BROADCAST_BYTES = 32 << 20


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    def weigh(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: int, value: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return F.forall(F.split(value, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda s: F.when(
            F.length(s) <= 3, F.coalesce(F.try_to_number(F.concat(F.lit("0"), s), F.lit("9999")), F.lit(0)) <= 255).otherwise(False)))
    low, high = (12, 19) if kind == 2 else (9, 15)
    return let(_digits(value), lambda d: F.when(F.length(d).between(low, high), _luhn(d) if kind == 2 else F.lit(True)).otherwise(False))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>> of the valid base matches."""
    out = []
    for kind, (pattern, need) in enumerate(zip(PATTERNS, NEEDS)):
        found = matches(text, pattern)
        if need:
            found = F.when(F.contains(text, F.lit(need)), found).otherwise(matches(F.lit(""), "x"))
        out.append(F.transform(F.filter(found, lambda s: _valid(kind, s["value"])), lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))
    return F.concat(*out)


def text_id(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def blank(text: Column, spans: Column) -> Column:
    """The text with spans (start, end, ...) overwritten by spaces, all positions kept."""
    empty = F.struct(F.lit(0).alias("at"), F.slice(F.array(F.lit("")), 1, 0).alias("out"))

    def rebuild(chars: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            start = F.greatest(acc["at"], s["start"])
            gap = F.array_join(F.slice(chars, acc["at"] + 1, start - acc["at"]), "")
            return F.when(s["end"] > acc["at"], F.struct(s["end"].alias("at"), F.concat(
                acc["out"], F.array(gap, F.repeat(F.lit(" "), s["end"] - start))).alias("out"))).otherwise(acc)
        return F.aggregate(F.array_sort(spans), empty, step, lambda acc: F.concat(
            F.array_join(acc["out"], ""), F.array_join(F.slice(chars, acc["at"] + 1, F.size(chars)), "")))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), rebuild))


def _words(text: Column, spans: Column) -> Column:
    """The different words outside the spans, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(blank(text, spans), F.lit(WORD), F.lit(0)), F.lower))


def units(span: Column) -> Column:
    """array<string>: the entity of a span and the units that recur with others: its group and its kind."""
    value, kind = F.lower(span["value"]), span["kind"].cast("string")
    group = (F.when(span["kind"] == 0, F.element_at(F.split(value, "@"), -1))
             .when(span["kind"] == 1, F.substring_index(value, ".", 2))
             .when(span["kind"] == 2, F.left(_digits(value), F.lit(6))).otherwise(F.left(_digits(value), F.lit(4))))
    return F.array(F.concat(F.lit("e"), kind, F.lit(":"), F.sha2(value, 256)), F.concat(F.lit("g"), kind, F.lit(":"), group),
                   F.concat(F.lit("k"), kind))


def lower_bound(hits: Column, of: Column, z: float) -> Column:
    """Wilson's lower confidence bound of a share."""
    p, n = hits / of, of.cast("double")
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def log_chance(hits: Column, of: Column, rate: float) -> Column:
    """Upper bound of ln P(X >= hits) for X binomial(of, rate): Chernoff's, exact where all are hits."""
    p = hits / of
    part = lambda share, base: F.when(share > 0, share * F.log(share / F.lit(base))).otherwise(0.0)
    kl = part(p, rate) + (part(1 - p, 1 - rate) if rate < 1 else F.lit(0.0))
    return F.when(p > rate, -of * kl).otherwise(0.0)


def within(df: DataFrame, size: Column, most: int | None = None) -> bool:
    """Whether the rows of ``df``, ``size`` bytes each, may be broadcast."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= (BROADCAST_BYTES if most is None else most)


def _string_bytes(name: str) -> Column:
    return F.octet_length(name) + 32


def disclosing_words(found: DataFrame, *, threshold: float = THRESHOLD, remove_at: float = REMOVE_AT,
                     confidence: float = CONFIDENCE, alpha: float = ALPHA) -> DataFrame:
    """term, remove: the words that disclose a unit, counted over whole texts.

    ``found``: one row per document (id, spans, words); equal texts count once.
    A word can reach the threshold for u only with
    docs(t) <= docs(u) ** threshold * N ** (1 - threshold). Units of a single text
    have the same counts there and are one unit. Of all units, one in just the
    word's texts with entities would be told best, so a word that fails either
    condition there fails it for every unit and meets none; neither do units of
    fewer texts than chance asks of words that stand in nothing else.
    """
    often = stage_table(found.groupBy("id").count().where("count > 1").select("id"), "pii-copies")
    if within(often, F.lit(96)):
        often = F.broadcast(often)
    one = found.select("id", "spans", "words")
    texts = one.join(often, "id", "left_anti").unionByName(one.join(often, "id", "left_semi").dropDuplicates(["id"]))
    holds = F.size("spans") > 0
    n, holding = texts.agg(F.count(F.lit(1)), F.count_if(holds)).first()
    n, rate = float(n), holding / n if holding else 1.0
    held = stage_table(texts.where(holds).select("id", F.explode(F.array_distinct(F.flatten(F.transform("spans", units)))).alias("unit")), "pii-units")
    unit_docs = held.groupBy("unit").agg(F.count(F.lit(1)).alias("unit_docs")).where(F.col("unit_docs") < n)
    held = stage_table(held.join(unit_docs, "unit").withColumn("unit", F.when(F.col("unit_docs") == 1, F.col("id")).otherwise(F.col("unit"))).distinct(), "pii-held")
    met = texts.where(holds).select("id", F.size("words").alias("n")).join(held.groupBy("id").agg(F.count(F.lit(1)).alias("m")), "id")
    tests = max(1, int(met.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 1))          # at least the pairs that meet in any text
    most_chance = math.log(alpha / tests)

    # what no unit can make up for: too few texts with entities for the word, however many of them hold the unit
    told_most = lower_bound(F.col("held_docs"), F.col("term_docs"), confidence)
    terms = (texts.select(holds.alias("holds"), F.explode("words").alias("term"))
                  .groupBy("term").agg(F.count(F.lit(1)).alias("term_docs"), F.count_if("holds").alias("held_docs"))
                  .where((F.col("held_docs") > 0) & (log_chance(F.col("held_docs"), F.col("term_docs"), rate) <= most_chance)
                         & (told_most * (1 + 1e-9) >= F.pow(F.col("held_docs") / n, F.lit(1 - threshold)))))
    terms = stage_table(terms.select("term", "term_docs"), "pii-terms")
    limit = F.pow(F.col("unit_docs"), F.lit(threshold)) * n ** (1 - threshold) * (1 + 1e-9)
    held = (held.where(log_chance(F.col("unit_docs"), F.col("unit_docs"), rate) <= most_chance)
                .groupBy("id").agg(F.collect_list(F.struct("unit", "unit_docs", limit.alias("limit"))).alias("units")))
    if within(held, F.aggregate(F.transform("units", lambda u: F.octet_length(u["unit"]) + 48), F.lit(96), lambda a, x: a + x)):
        held = F.broadcast(held)
    if within(terms, _string_bytes("term")):
        terms = F.broadcast(terms)
    words = texts.where(holds).join(held, "id").select("units", F.explode("words").alias("term"))
    pairs = (words.join(terms, "term").select("term", "term_docs", F.explode(F.filter("units", lambda u: u["limit"] >= F.col("term_docs"))).alias("u"))
                  .groupBy("term", "term_docs", "u.unit", "u.unit_docs").agg(F.count(F.lit(1)).alias("both")))
    information = F.log2(F.lit(n) / F.col("unit_docs"))
    pmi = F.log2(lower_bound(F.col("both"), F.col("term_docs"), confidence) * n / F.col("unit_docs"))
    told = pairs.withColumn("disclosure", pmi / information).where(
        (F.col("disclosure") >= threshold) & (log_chance(F.col("both"), F.col("term_docs"), rate) <= most_chance))
    return stage_table(told.groupBy("term").agg((F.max("disclosure") >= remove_at).alias("remove")), "pii-flagged")


def word_places(text: Column, hits: Column) -> Column:
    """array<struct<start, end, remove>> of the words numbered in ``hits`` (array<struct<i, remove>>).

    Sums over blocks of about the square root of the word count, so the cost is
    the words plus the hits times that root.
    """
    def total(lengths: Column) -> Column:
        return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)

    def placed(words: Column, gaps: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, 1, F.size(words)), words, lambda g, w: F.length(g) + F.length(w))

        def blocks(step: Column, width: Column) -> Column:
            n = F.floor((F.size(step) - 1) / width).cast("int")
            sums = F.transform(F.sequence(F.lit(0), n), lambda b: total(F.slice(step, b * width + 1, width)))
            bases = let(sums, lambda each: F.transform(F.sequence(F.lit(0), n), lambda b: total(F.slice(each, 1, b))))

            def place(h: Column, base: Column) -> Column:
                b = F.floor(h["i"] / width).cast("int")
                start = F.get(base, b) + total(F.slice(step, b * width + 1, h["i"] - b * width)) + F.length(F.get(gaps, h["i"]))
                return F.struct(start.alias("start"), (start + F.length(F.get(words, h["i"]))).alias("end"), h["remove"].alias("remove"))
            return let(bases, lambda base: F.transform(hits, lambda h: place(h, base)))
        return let(steps, lambda step: let(F.ceil(F.sqrt(F.size(step))).cast("int"), lambda width: blocks(step, width)))
    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda words: let(F.split(text, WORD, -1), lambda gaps: placed(words, gaps)))


def _term_spans(found: DataFrame, texts: DataFrame, **limits) -> DataFrame:
    """Per text id: ``added``, the places of its disclosing words."""
    flagged = disclosing_words(found, **limits)
    if within(flagged, _string_bytes("term")):
        flagged = F.broadcast(flagged)
    # per text its flagged words: few; the places are found inside the text's row
    told = stage_table(found.select("id", F.explode("words").alias("term")).join(flagged, "term").distinct()
                       .groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "remove"))).alias("told")), "pii-told")
    if within(told, F.aggregate(F.map_keys("told"), F.lit(96), lambda a, x: a + F.octet_length(x) + 16)):
        told = F.broadcast(told)
    clean = texts.join(told, "id").select("id", "told", let(base_spans(F.col("text")), lambda spans: blank(F.col("text"), spans)).alias("clean"))
    clean = clean.dropDuplicates(["id"])

    def hits(words: Column) -> Column:
        numbered = F.transform(words, lambda w, i: F.struct(i.alias("i"), F.try_element_at("told", F.lower(w)).alias("remove")))
        return F.filter(numbered, lambda h: h["remove"].isNotNull())

    found_at = let(F.regexp_extract_all("clean", F.lit(WORD), F.lit(0)), hits)
    return clean.select("id", word_places(F.col("clean"), found_at).alias("added")).where(F.size("added") > 0)


def _found(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    d = inner_names(docs, {key: "key", text: "text"}).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("id", text_id(F.col("text")))
    found = d.select("key", "id", "text", base_spans(F.col("text")).alias("spans"))
    return d, stage_table(found.select("key", "id", "spans", _words(F.col("text"), F.col("spans")).alias("words")), "pii-found")


def _added(column: str) -> Column:
    none = F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(False).alias("remove"))), 1, 0)
    return F.coalesce(F.col(column), none)


def pii_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Per input row: key, spans (array of start, kind position, end), base kinds and terms.

    Null texts are empty and have no spans; repeated rows come back as often;
    texts are read whole; other columns are ignored.
    """
    texts, found = _found(docs, key, text)
    with temporary_tables(docs.sparkSession):
        added = stage_table(_term_spans(found, texts, **limits), "pii-added", keep=True)
    if within(added, F.size("added") * 16 + 96):
        added = F.broadcast(added)
    out = found.join(added, "id", "left")
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    terms = F.transform(_added("added"), lambda s: F.struct(s["start"].alias("start"), F.lit(TERM).alias("kind"), s["end"].alias("end")))
    return out.select(F.col("key").alias(key), F.concat(base, terms).alias("spans"))


def pii_report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans (as text)."""
    s = pii_spans(docs, key=key, text=text, **limits)
    base = F.filter("spans", lambda x: x["kind"] < TERM)
    return s.select(key, *[count_kind(F.col("spans"), n).alias(f"n_{k}") for n, k in enumerate(BASE_KINDS)],
                    sha256_text(joined(base, KINDS)).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """The text with spans (start, end, label) replaced by their labels.

    A span that begins inside an earlier one only extends what is cut there.
    Works on an array of code points, so it is linear in the text.
    """
    empty = F.struct(F.lit(0).alias("at"), F.slice(F.array(F.lit("")), 1, 0).alias("out"))

    def rebuild(chars: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            gap = F.array_join(F.slice(chars, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), "")
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                            F.when(fresh, F.concat(acc["out"], F.array(gap, s["label"]))).otherwise(acc["out"]).alias("out"))
        return F.aggregate(F.array_sort(spans), empty, step, lambda acc: F.concat(
            F.array_join(acc["out"], ""), F.array_join(F.slice(chars, acc["at"] + 1, F.size(chars)), "")))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), rebuild))


def sanitise(docs: DataFrame, *, text: str = "text", **limits) -> DataFrame:
    """The input with its text sanitised; all rows and columns are kept.

    Base entities become placeholders, disclosing words are generalised to
    ``[WORD]`` or removed. Null texts stay null.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    with temporary_tables(docs.sparkSession):
        d, found = _found(docs, docs.columns[0], text)
        added = stage_table(_term_spans(found, d, **limits), "pii-added", keep=True)
    if within(added, F.size("added") * 16 + 96):
        added = F.broadcast(added)
    own = F.col(names[text])
    rows = inner_names(docs, names).withColumn("id", text_id(F.coalesce(own, F.lit("")))).join(added, "id", "left")
    labels = F.array(*[F.lit(p) for p in PLACEHOLDERS])
    base = F.transform(base_spans(own), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(labels, s["kind"]).alias("label")))
    terms = F.transform(_added("added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                            F.when(s["remove"], F.lit("")).otherwise(F.lit(PLACEHOLDERS[TERM])).alias("label")))
    clean = F.when(own.isNotNull(), let(F.concat(base, terms), lambda spans: mask(own, spans)))
    return rows.select(*[(clean if c == text else F.col(n)).alias(c) for c, n in names.items()])
