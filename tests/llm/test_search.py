"""Lexical search against a brute-force ranking."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from covenant.llm import search as S

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rank", T.StringType())])


def brute(docs, items, k=20):
    """Sorted (item_id, rank, doc_id, score) by the ranking's definition, each row a document."""
    terms = [(i, S.terms_of(t)) for i, t in docs]
    n = sum(1 for _, w in terms if w)
    total = sum(len(w) for _, w in terms)
    df = Counter(x for _, w in terms for x in set(w))
    out = []
    for item, text in items:
        scored = []
        for doc, w in terms:
            if not w:
                continue
            m, tf = 75 + (25 * len(w) * n) // total, Counter(w)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + 12 * m))
                    for x in S.terms_of(text) if tf[x])
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        for r, (s, none, doc) in enumerate(sorted(scored)[:k], 1):
            out.append((item, r, None if none else doc, -s))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Über", "naïve", "x1"]
    weight = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weight, k=rng.choice((3, 20, 60, 400))))) for i in range(300)]
    hot = " ".join(words[300:330])
    docs += [(1000 - i, hot) for i in range(150)]                       # a third of the rows is one text
    docs += [(2000 + i, hot + " " + words[i]) for i in range(60)]
    docs += [(7, "w399 w399"), (7, "w398"), (None, "w399 W398"), (None, None), (5, ""), (6, "!!! --")]
    items = [(i, " ".join(rng.choices(words, k=rng.choice((1, 4, 25))))) for i in range(40)]
    items += [(100, hot), (101, "w399, W398; w399"), (102, None), (103, ""), (104, "never-seen zzz"), (100, hot), (None, "über w1")]
    return docs, items


def test_matches_brute_force(spark, make_docs, odd_rows, corpus):
    docs, items = corpus
    docs = docs + odd_rows
    queries = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    got = found(S.search(make_docs(docs), queries))
    assert got == brute(docs, items)


def test_blocks_and_few_results(spark, make_docs, corpus, monkeypatch):
    """Small blocks and index groups, few documents first, pairs joined by a shuffle: the same result."""
    docs, items = corpus
    monkeypatch.setattr(S, "BLOCK_TERMS", 60)
    monkeypatch.setattr(S, "INDEX_TERMS", 300)
    monkeypatch.setattr(S, "FIRST", 1)
    monkeypatch.setattr(S, "BROADCAST_PAIRS", 0)
    items = items[:6] + items[40:]
    queries = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    assert found(S.search(make_docs(docs, extra=False), queries, k=3)) == brute(docs, items, 3)


def test_empty_tables(spark, make_docs):
    queries = spark.createDataFrame([(1, "a b", "x")], ITEMS)
    assert found(S.search(make_docs([]), queries)) == []
    assert found(S.search(make_docs([(1, "a b")]), queries.where("false"))) == []
    out = S.search(make_docs([(1, "a b")]), queries)
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert found(out) == brute([(1, "a b")], [(1, "a b")])


def test_bounds_are_upper_bounds():
    """Also where terms share coordinates and counts are rounded."""
    rng = random.Random(1)
    texts = [" ".join(rng.choices([f"t{i}" for i in range(50)], k=n)) for n in (1, 5, 70, 3000, 20000)]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *map(len, texts)])
    counts = [Counter(S.terms_of("t1 t2 t2 t49")), Counter(S.terms_of("t7")), Counter(["none"])]
    wanted = np.unique(S.term_hashes(sorted({t for c in counts for t in c})))
    n, at, most, df = S.sketches(np.frombuffer(data, np.uint8), offsets, wanted)
    total = int(n.sum())
    block = S.Block(counts, {h: d for h, d in zip(wanted.view(np.int64).tolist(), df.tolist()) if d}, len(texts), total)
    bounds = block.bounds(n, at, most)
    assert block.asked.tolist() == [0, 1]
    for r, t in enumerate(texts):
        known = Counter(i for i in map(block.term.get, S.terms_of(t)) if i is not None)
        m = int(S.length_norm(np.int64(len(S.terms_of(t))), len(texts), total))
        for j, q in enumerate(block.asked.tolist()):
            assert block.score(known, m, q) <= bounds[r, j] <= 1.2 * block.score(known, m, q) + 1


def test_codes_round_up():
    counts = np.array([1, 2, 64, 65, 100, 12345, 10**9, 10**15, 1 << 61])
    codes = np.searchsorted(S.CODES, counts)
    assert codes.max() < 256 and (S.CODES[codes] >= counts).all() and (S.CODES[codes[:3]] == counts[:3]).all()


def test_long_text(make_docs, spark):
    long = "alpha " * 400_000 + "omega"
    queries = spark.createDataFrame([(1, "omega alpha", "x"), (2, "beta", "x")], ITEMS)
    docs = [(1, long), (2, "omega"), (3, "beta alpha")]
    assert found(S.search(make_docs(docs), queries)) == brute(docs, [(1, "omega alpha"), (2, "beta")])
