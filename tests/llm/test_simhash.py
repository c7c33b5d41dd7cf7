"""SimHash near-duplicates against brute force."""

import random

import xxhash
from pyspark.sql import functions as F

from covenant.llm import simhash as H


def fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, distance=2):
    """Least index reachable by links, for each value."""
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= distance:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(values))]


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    roots = classes(prints)
    least = {}
    for (k, _), r in zip(rows, roots):
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return sorted(((k, f"{p:016x}", least.get(r)) for (k, _), p, r in zip(rows, prints, roots)), key=str)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_matches_brute_force(make_docs, odd_rows):
    rng = random.Random(3)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    rows = list(odd_rows) + [(90, "café au"), (91, "CAFé\tau"), (92, "one"), (93, "A B c")]
    for i in range(100, 140):                                        # near copies
        words = list(base)
        words[rng.randrange(len(words))] = f"n{i}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base).upper()) for i in range(60)] + [(300 + i, " ".join(rng.choices(base, k=40))) for i in range(20)]
    got = sorted(((r[0], r[1], r[2]) for r in H.simhash_components(make_docs(rows)).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(make_docs):
    out = H.simhash_components(make_docs([]))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


def test_fingerprint_of_a_long_text_goes_in_chunks(make_docs):
    text = " ".join(f"w{i * i % 7919}" for i in range(150_000))
    row = H.simhash_components(make_docs([(1, text)])).first()
    assert row["fingerprint"] == f"{fingerprint(text):016x}"


def test_links_lose_none(spark):
    """Random, close and extreme fingerprints on both grids; crowded cells go to the finest one."""
    rng = random.Random(9)
    values = {0, (1 << 64) - 1, 1 << 63, 3 << 62}
    for _ in range(40):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(6):
            w = v
            for _ in range(rng.choice((1, 2, 3, 4))):
                w ^= 1 << rng.randrange(64)
            values.add(w)
    values = sorted(values)
    prints = spark.createDataFrame([(signed(v),) for v in values], "f bigint")
    want = {(min(signed(a), signed(b)), max(signed(a), signed(b))) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2}
    for options in ({}, {"segments": 32}, {"segments": 8, "cell_rows": 4}, {"cell_rows": 1}, {"segments": 64}):
        assert {tuple(r) for r in H.fingerprint_links(prints, **options).collect()} == want
    assert {tuple(r) for r in H.fingerprint_links(prints, distance=0).collect()} == set()


def test_crowded_ball_stays_linear(spark):
    """All fingerprints within two bits of one: the finest grid holds at most 65 a cell."""
    centre = random.Random(4).getrandbits(64)
    ball = {centre} | {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64) if a != b} | {centre ^ (1 << a) for a in range(64)}
    prints = spark.createDataFrame([(signed(v),) for v in ball], "f bigint")
    assert H._entries(prints, 64).groupBy("cell").count().agg(F.max("count")).first()[0] <= 65
    values = sorted(ball)
    want = sum((a ^ b).bit_count() <= 2 for i, a in enumerate(values) for b in values[:i])
    assert H.fingerprint_links(prints, cell_rows=16).count() == want


def test_entries_are_never_broadcast(spark):
    """A small table of fingerprints has 33 or 65 entries each, which Spark's estimate leaves out."""
    prints = spark.range(1000).select(F.xxhash64("id").alias("f"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for segments in (16, 32, 64):
        met = plan(H._meet(H._entries(prints, segments), 2))
        assert "SortMergeJoin" in met and "Broadcast" not in met
    # of the whole plan, only the list of crowded cells may be broadcast: at most one a cell_rows of the entries
    links = plan(H.fingerprint_links(prints))
    joins = [line for line in links.splitlines() if "BroadcastHashJoin" in line]
    assert all("LeftAnti" in j or "LeftSemi" in j for j in joins)
