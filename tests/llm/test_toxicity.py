import random
import zlib

import numpy as np
import pyarrow as pa

from covenant.llm.common import SPACE, Words, passes
from covenant.llm.toxicity import _feature_blocks, features, slopes, toxicity, train

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=1500):
    rnd = random.Random(6)
    vocab = [f"{a}{b}{i}" for a in ("an", "the", "ro") for b in ("li", "mo") for i in range(60)]
    rows, toxic = [], {}
    for i in range(n):
        words = rnd.choices(vocab, k=rnd.randint(20, 120))
        toxic[i] = int(i % 8 == 0)
        if toxic[i]:
            for w in rnd.choices(["grumble", "snarlish", "snarling", "Blighted", "vexation"], k=5):
                words.insert(rnd.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
    return rows, toxic


def test_held_out_accuracy_and_odd_rows(spark, make_docs, odd_rows):
    rows, toxic = corpus()
    odd = [(None if i is None else 10_000 + i, t) for i, t in odd_rows]
    rnd = random.Random(1)
    given = [(i, 1, t) for i, t in toxic.items() if rnd.random() < 0.6]
    labels = spark.createDataFrame(given + [(None, 1, 1), (5, 1, None), (0, 1, 1)], LABELS)
    out = toxicity(make_docs(rows + odd), labels).collect()
    assert len(out) == len(rows + odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    for r in out:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
    held = [(r.predicted, toxic[r.doc_id]) for r in out if r.held_out and r.doc_id in toxic]
    assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.03 * len(held)
    same = [r.score for r in out if r.doc_id in (10_002, 10_003)]
    assert same[0] == same[1]                       # null and empty text


def test_labels_of_held_out_rows_are_not_used(spark, make_docs):
    rows, toxic = corpus(400)
    held = {i for i in toxic if zlib.crc32(str(i).encode()) % 5 == 0}
    docs = make_docs(rows)
    a = toxicity(docs, spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], LABELS))
    b = toxicity(docs, spark.createDataFrame([(i, 1, 1 - t if i in held else t) for i, t in toxic.items()], LABELS))
    assert dict(a.select("doc_id", "score").collect()) == dict(b.select("doc_id", "score").collect())


def test_risk_is_not_driven_below_zero():
    rng = np.random.default_rng(0)
    lists = [np.unique(rng.integers(0, 50, 6)) for _ in range(300)]
    positive = np.arange(300) < 100
    lists = [np.append(x, 60) if p else x for x, p in zip(lists, positive)]
    w = train(lists, positive, 0.2, 1)
    assert np.isfinite(w).all() and w[60] > 0


def test_features_per_document():
    (_, _, data, offsets), = passes(pa.array(["Hello hello HELLOWORLD", "", None, "é" * 9]))
    doc, f = features(Words(data, offsets, SPACE, lower=True))
    assert np.bincount(doc, minlength=4).tolist() == [2 + 4 - 0, 0, 0, 5]


def test_empty_and_no_labels(spark, make_docs):
    none = spark.createDataFrame([], LABELS)
    assert toxicity(make_docs([]), none).collect() == []
    assert len(toxicity(make_docs([(1, "a b"), (2, None)]), none).collect()) == 2


def risk(z, is_pos, prior):
    """The non-negative risk and its clean part, term by term."""
    loss = lambda x: np.log1p(np.exp(-x))
    pos, unl = [x for x, p in zip(z, is_pos) if p], [x for x, p in zip(z, is_pos) if not p]
    toxic = prior * sum(loss(x) for x in pos) / len(pos)
    clean = sum(loss(-x) for x in unl) / len(unl) - prior * sum(loss(-x) for x in pos) / len(pos)
    return toxic + max(0.0, clean), clean


def test_slopes_against_differences_of_the_brute_force_risk():
    rng = np.random.default_rng(4)
    signs = set()
    for prior, spread, gap in ((0.2, 1.0, 3.0), (0.5, 3.0, 3.0), (0.3, 2.0, -2.0), (0.2, 1.0, 0.0)):
        is_pos = np.arange(12) < 5
        z = rng.normal(0, spread, 12) + np.where(is_pos, gap, -gap)
        clean = risk(z, is_pos, prior)[1]
        signs.add(clean < 0)
        got = slopes(z, is_pos, prior)
        for i in range(12):
            up, down = z.copy(), z.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            part = (lambda v: -risk(v, is_pos, prior)[1]) if clean < 0 else (lambda v: risk(v, is_pos, prior)[0])
            assert abs((part(up) - part(down)) / 2e-5 - got[i]) < 1e-6
    assert signs == {True, False}


def test_counts_and_shift_cover_all_training_documents(spark, make_docs):
    rows, toxic = corpus(600)
    docs = make_docs(rows, extra=False)
    counts, n = _feature_blocks(docs.select("text"))
    (_, _, data, offsets), *more = passes(pa.array([t for _, t in rows]))
    lists = [features(Words(d, o, SPACE, lower=True))[1] for d, o in [(data, offsets), *((d, o) for _, _, d, o in more)]]
    assert n == 600 and (counts == np.bincount(np.concatenate(lists), minlength=len(counts))).all()
    labels = spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], LABELS)
    out = toxicity(docs, labels, positives=20, unlabelled=30).collect()
    train_rows = [r for r in out if not r.held_out]
    prior = sum(toxic[r.doc_id] for r in train_rows) / len(train_rows)
    assert abs(sum(r.score for r in train_rows) / len(train_rows) - prior) < 0.01
