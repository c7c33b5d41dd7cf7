import math
import random
import re
from collections import Counter

import numpy as np

from covenant.llm.quality import binomial_tail, keep_quality, quality_rules, select_cutoff, upper_bound

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = Counter(wins)
    rep = {j for i, x in enumerate(wins) if often[x] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep),
            len(w) < 10 or 100 * len(rep) > 20 * len(w))


def test_measures_against_brute_force(spark, make_docs, odd_rows):
    rnd = random.Random(3)
    bits = ["one", "two", "three", "é#", "😀", "*", "\n", "\n\n", " ", "\t", "\x0b", "\x00", "<b>", "same line here\n", "\r\n", "a b c d e f "]
    rows = odd_rows + [(100 + i, " ".join(rnd.choices(bits, k=rnd.randint(0, 60)))) for i in range(300)]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(make_docs(rows), labels).collect()]
    assert sorted(got, key=repr) == sorted([(i, *brute(t)) for i, t in rows], key=repr)


def test_exact_bounds():
    direct = sum(math.comb(50, i) * 0.1**i * 0.9**(50 - i) for i in range(4))
    assert abs(binomial_tail(3, 50, 0.1) - direct) < 1e-12
    assert abs(binomial_tail(3, 50, upper_bound(3, 50, 0.05)) - 0.05) < 1e-9
    assert abs(upper_bound(0, 100, 0.05) - (1 - 0.05 ** 0.01)) < 1e-9
    assert binomial_tail(40_000, 1_000_000, 0.05) < 1e-9


def test_cutoffs_are_certified():
    level = np.arange(4)
    cut, bound = select_cutoff(level, np.array([5000, 200, 2, 0]), np.array([10, 10, 200, 300]), 0.01, 0.01)
    assert cut == 1 and 2 / 5202 < bound <= 0.01
    assert select_cutoff(level, np.array([50, 2, 0, 0]), np.array([0, 0, 90, 90]), 0.01, 0.01)[0] is None      # too few labels
    assert select_cutoff(level, np.array([5000, 0, 0, 0]), np.array([900, 0, 0, 0]), 0.01, 0.01)[0] is None    # nothing to gain


def test_false_rejections_stay_limited(spark, make_docs):
    rnd = random.Random(5)
    words = [f"word{i}" for i in range(3000)]
    rows, labels = [], []
    for i in range(4000):
        bad = i % 5 == 0
        rows.append((i, " ".join(w + ("%%%" if bad else "") for w in rnd.sample(words, 30 + i % 2))))
        if i % 8 < 7:
            labels.append((i, 0 if bad else 1))
    df = make_docs(rows)
    lab = spark.createDataFrame(labels + [(None, 0), (1, None)], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in quality_rules(df, lab, max_false=0.06).collect()}
    good, bad = [out[i] for i in out if i % 5], [out[i] for i in out if i % 5 == 0]
    assert sum(good) >= 0.97 * len(good) and not any(bad)
    kept = keep_quality(df, lab, max_false=0.06)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, k in out.items() if k}


def test_empty(spark, make_docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality_rules(make_docs([]), labels).collect() == []
    assert keep_quality(make_docs([]), labels).collect() == []
