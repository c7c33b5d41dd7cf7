import hashlib
import random
import re

import pytest

from covenant.llm import decontaminate
from covenant.llm.decontaminate import contamination_report, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, size=10):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(size, len(v))
        wins = {tuple(v[p:p + n]) for p in range(len(v) - n + 1)} if n else set()
        for p in range(len(w) - n + 1 if n else 0):
            if tuple(w[p:p + n]) in wins:
                hit.update(range(p, p + n))
                ids.add("" if i is None else str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def cases():
    rnd = random.Random(7)
    vocab = ["alpha", "beta", "Gamma", "déjà", "x1", "42", "the", "of"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(8, 25)))) for i in range(12)]
    items += [(20, "the of"), (21, "solo"), (22, None), (23, ""), (24, "!!"), (25, items[3][1]), (3, items[3][1]), (None, items[4][1]),
              (30, "the " * 40), (31, "one TWO three-four five, six; seven eight nine ten eleven twelve")]
    docs = [(100 + i, " ".join(rnd.choices(vocab + ["Solo"], k=rnd.randint(0, 60)))) for i in range(60)]
    docs += [(200 + i, "start " + t + " END") for i, (_, t) in enumerate(items) if t]
    docs += [(300, "one two three four five six seven eight nine ten"), (301, "One.Two\nThree\tfour FIVE six seven eight nine"), (302, "the " * 5000),
             (303, items[5][1]), (303, items[5][1]), (None, items[6][1]), (304, None), (305, ""), (306, "Ünïcödé " * 30)]
    return docs, items


@pytest.mark.parametrize("bound,bits", [(decontaminate.BROADCAST_WINDOWS, 22), (0, 22)])
def test_against_brute_force(spark, make_docs, odd_rows, cases, monkeypatch, bound, bits):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
    docs, items = cases
    docs = docs + odd_rows
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string").repartition(2)
    got = [tuple(r) for r in contamination_report(make_docs(docs), bench).collect()]
    assert sorted(got, key=repr) == sorted([(i, *brute(t, items)) for i, t in docs], key=repr)


def test_drop_keeps_clean_rows(spark, make_docs, cases):
    docs, items = cases
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = make_docs(docs)
    out = drop_contaminated(df, bench)
    assert out.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=repr) == sorted([(i, t) for i, t in docs if not brute(t, items)[4]], key=repr)


def test_empty(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contamination_report(make_docs([]), some).collect() == []
    assert contamination_report(make_docs([(1, "a b c")]), none).first().n_hit == 0
