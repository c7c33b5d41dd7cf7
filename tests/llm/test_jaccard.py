import os
import random
import re

import numpy as np
import pytest

from covenant.llm import jaccard
from covenant.llm.jaccard import jaccard_components, keep_one_of_each, tile_overlaps

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    ids = {}
    for i, (key, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(key)
    return [(key, len(s), min((k for k in ids[find(i)] if k is not None), default=None) if s else key) for i, ((key, _), s) in enumerate(zip(rows, sets))], \
        [find(i) for i in range(len(rows))]


def cases(odd_rows):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    rows, common = list(odd_rows), " ".join(rnd.choices(vocab, k=40))
    for f in range(30):
        base = rnd.choices(vocab, k=rnd.choice([3, 6, 9, 12, 20, 35, 60, 120, 300]))
        rows.append((1000 + 20 * f, " ".join(base)))
        for c in range(9):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                p = rnd.randrange(len(w))
                w[p:p + rnd.choice([0, 1, 2])] = rnd.choices(vocab, k=rnd.randint(0, 2))
            rows.append((1000 + 20 * f + c + 1, (" ".join(w)).upper() if c % 4 == 0 else " \n".join(w)))
    rows += [(3000 + i, common + " " + " ".join(rnd.choices(vocab, k=i))) for i in range(40)]           # one passage, and a chain of growing texts
    rows += [(4000 + i, " ".join(vocab[i:200 + i])) for i in range(0, 60, 3)]                            # a chain of sliding texts
    rows += [(5000 + i, " ".join(vocab[:150])) for i in range(30)]
    return rows


@pytest.mark.parametrize("k,num,den,few", [(3, 90, 100, 64), (5, 80, 100, 2)])
def test_components_against_brute_force(make_docs, odd_rows, monkeypatch, k, num, den, few):
    monkeypatch.setattr(jaccard, "DIRECT", few)
    monkeypatch.setattr(jaccard, "TILE", 5)
    monkeypatch.setattr(jaccard, "PEELS", 2)
    rows = cases(odd_rows)
    want, _ = brute(rows, k, num, den)
    got = [tuple(r) for r in jaccard_components(make_docs(rows), shingle=k, num=num, den=den).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("bound", [jaccard.BROADCAST_CLASSES, 0])
def test_one_of_each_group_stays(make_docs, odd_rows, monkeypatch, bound):
    monkeypatch.setattr(jaccard, "BROADCAST_CLASSES", bound)
    rows = cases(odd_rows)
    _, group = brute(rows, 5, 80, 100)
    docs = make_docs(rows)
    out = keep_one_of_each(docs)
    assert out.columns == docs.columns
    keep = {}
    for (key, t), g in zip(rows, group):
        keep.setdefault(g, []).append((key is None, key or 0, key))
    want = sorted(min(v)[2] if min(v)[2] is not None else -1 for v in keep.values())
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == want


def test_tiles_discard_only_pairs_below_the_bound(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    pivot = np.unique(rng.integers(0, 400, 90)).astype(np.uint64)
    lists = []
    for i in range(60):
        drop = rng.random(len(pivot)) < 0.004 * i
        lists.append(np.unique(np.concatenate((pivot[~drop], rng.integers(0, 400, rng.integers(0, 5)).astype(np.uint64)))))
    lists.append(np.zeros(0, np.uint64))
    got = tile_overlaps(pivot, lists, 90, 100)
    for x, o in zip(lists, got):
        both = len(np.intersect1d(x, pivot))
        assert o == (both if 100 * both >= 90 * (len(x) + len(pivot) - both) else -1)


def test_bucket_bounds_hold():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    doc, h = np.repeat(np.arange(40), [len(s) for s in sets]), np.concatenate(sets)
    counts = jaccard.bucket_counts(doc, h, 40)
    most = jaccard.overlap_bounds(counts[:20] + [b""], counts[20:] + [counts[0]])
    assert all(m >= len(np.intersect1d(a, b)) for m, a, b in zip(most, sets[:20], sets[20:]))
    assert most[-1] > 1 << 40


@pytest.mark.parametrize("n", [400, 4000, 20_000])
def test_bounds_tell_large_rows_apart(n):
    """Pairs well below the similarity asked for go before their sets move, whatever the rows' sizes."""
    rng = np.random.default_rng(n)
    for other in (n, n * 9 // 10):
        for share in (0, 50, 80):
            pool = rng.integers(0, 1 << 62, 2 * n).astype(np.uint64)
            both = other * share // 100
            a, b = np.unique(pool[:n]), np.unique(pool[n - both:n - both + other])
            counts = jaccard.bucket_counts(np.repeat([0, 1], [len(a), len(b)]), np.concatenate((a, b)), 2)
            most = jaccard.overlap_bounds(counts[:1], counts[1:])[0]
            assert len(np.intersect1d(a, b)) <= most < -(-(len(a) + len(b)) * 80 // 180)
            assert max(map(len, counts)) <= 8 + n // 4


@pytest.mark.parametrize("buckets", [8, 64, 1 << 16])
def test_bounds_hold_between_rows_of_all_sizes(monkeypatch, buckets):
    monkeypatch.setattr(jaccard, "MOST_BUCKETS", buckets)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 4000, k).astype(np.uint64)) for k in (1, 2, 5, 9, 40, 200, 201, 1500, 3000)] + [np.zeros(0, np.uint64)]
    counts = jaccard.bucket_counts(np.repeat(np.arange(10), [len(x) for x in sets]), np.concatenate(sets), 10)
    for x, c in zip(sets, counts):
        assert (jaccard.overlap_bounds([c] * 10, counts) >= [len(np.intersect1d(x, y)) for y in sets]).all()
        assert jaccard.overlap_bounds([c], [c])[0] == len(x)


def test_prefixes_of_linked_rows_meet():
    rng = np.random.default_rng(2)
    sketch = rng.integers(0, 50, jaccard.CELLS).astype(np.uint16)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 62, rng.integers(0, 4)).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 90 * (len(a) + len(b) - both):
            x, y = (jaccard.prefixes(np.zeros(len(h), np.int64), h, np.array([len(h)]), sketch, 90, 100)[1] for h in (a, b))
            assert len(np.intersect1d(x, y))


def test_empty(make_docs):
    assert jaccard_components(make_docs([])).collect() == []
    assert keep_one_of_each(make_docs([])).collect() == []


def staged(spark):
    from covenant.session import checkpoint_dir
    folder = checkpoint_dir(spark).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.startswith("llm-")}


def test_only_the_decisions_stay_on_disk(spark, make_docs, odd_rows):
    docs, before = make_docs(cases(odd_rows)[:150]), staged(spark)
    out = keep_one_of_each(docs)
    left = staged(spark) - before
    assert [n.rsplit("-", 1)[0] for n in left] == ["llm-duplicate-decisions"]
    assert out.count() == len(out.select("doc_id", "text").collect()) > 0


def test_large_meetings_take_two_rounds(make_docs, odd_rows, monkeypatch):
    """Pivots of several components are taken at once, so rounds do not grow with PEELS."""
    rounds, possible = [], jaccard._possible
    monkeypatch.setattr(jaccard, "_possible", lambda *a: rounds.append(1) or possible(*a))
    monkeypatch.setattr(jaccard, "DIRECT", 2)
    rows = cases(odd_rows)
    want, _ = brute(rows, 5, 80, 100)
    got = [tuple(r) for r in jaccard_components(make_docs(rows), shingle=5, num=80, den=100).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(rounds) <= 3


@pytest.mark.parametrize("links", [[], [(5, 1)], [(2, 1), (3, 2), (4, 3), (9, 8), (9, 7)], [(i + 1, i) for i in range(40)]])
def test_components_of_links(spark, links):
    from covenant.llm.graph import components
    before = staged(spark)
    out = components(spark.createDataFrame(links, "u long, v long"))
    least = {n: n for e in links for n in e}
    for _ in least:
        for u, v in links:
            least[u] = least[v] = min(least[u], least[v])
    assert sorted(tuple(r) for r in out.collect()) == sorted(least.items())
    assert len(staged(spark) - before) == 1


def test_bitmaps_are_put_together_by_spark(spark):
    from covenant.llm.common import bitmap
    values = [0, 1, 7, 8, 32767, 32768, (1 << 22) - 1, -1, -(1 << 60), 1 << 40, 123456789012345]
    bits = np.unpackbits(bitmap(spark.createDataFrame([(v,) for v in values * 2], "v long"), "v", 22))
    assert sorted(np.flatnonzero(bits).tolist()) == sorted({v & ((1 << 22) - 1) for v in values})
    assert not bitmap(spark.createDataFrame([], "v long"), "v", 22).any()
