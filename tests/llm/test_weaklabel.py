import math
import random
import re

import numpy as np
import pyarrow as pa

from covenant.llm import weaklabel as wl
from covenant.llm.common import Words, passes
from covenant.llm.weaklabel import ABSTAIN, GOOD, LABELLERS, estimate, quality_classifier


def test_em_recovers_accuracies():
    rng = np.random.default_rng(2)
    n, truth = 20_000, None
    truth = rng.random(n) < 0.8
    accuracy, cast = np.array([0.95, 0.85, 0.75, 0.9, 0.65]), np.array([0.9, 0.7, 0.8, 0.4, 0.6])
    right = rng.random((n, 5)) < accuracy
    votes = np.where(rng.random((n, 5)) < cast, np.where(right == truth[:, None], GOOD, 0), ABSTAIN)
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, chance = estimate(patterns, counts.astype(float))
    found = chance[1, :, GOOD] / (chance[1, :, GOOD] + chance[1, :, 0])
    assert np.abs(found - accuracy).max() < 0.03
    assert ((post[back.ravel()] >= 0.5) == truth).mean() > 0.93
    majority = (votes == GOOD).sum(1) >= (votes == 0).sum(1)
    assert ((post[back.ravel()] >= 0.5) == truth).mean() >= (majority == truth).mean()


def texts():
    rnd = random.Random(8)
    vocab = [f"{a}{b}" for a in ("ab", "cel", "dor", "fin", "gu", "hal") for b in ("an", "eth", "ing", "or", "is", "um", "ed", "ly")]
    rows, good = [], {}
    for i in range(600):
        sentence = lambda: (" ".join(rnd.choices(vocab, k=rnd.randint(6, 12))) + ".").capitalize()
        t = " ".join(sentence() for _ in range(rnd.randint(5, 12)))
        good[i] = i % 4 != 0
        if not good[i]:
            t = [" | ".join(t.split()[:60]), " ".join(w.upper() + "!!" for w in t.split()), (t.split(".")[0] + ".\n") * 12][i // 4 % 3]
        rows.append((i, t))
    return rows, good


def test_separates_good_from_junk_and_odd_rows(make_docs, odd_rows):
    rows, good = texts()
    odd = [(None if i is None else 10_000 + i, t) for i, t in odd_rows]
    out = quality_classifier(make_docs(rows + odd)).collect()
    assert len(out) == len(rows + odd)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 and r.predicted in (0, 1) for r in out)
    by = {r.doc_id: r for r in out}
    kept = [by[i].predicted for i in good if good[i]]
    junk = [by[i].predicted for i in good if not good[i]]
    assert np.mean(kept) >= 0.97 and np.mean(junk) <= 0.1
    scored = np.mean([by[i].score for i in good if good[i]]) - np.mean([by[i].score for i in good if not good[i]])
    assert scored > 0.3
    assert {getattr(by[10_002], f"vote_{n}") for n in LABELLERS} <= {-1, 0, 1}
    assert by[10_002].posterior == by[10_003].posterior


def test_empty(make_docs):
    assert quality_classifier(make_docs([])).collect() == []
    assert len(quality_classifier(make_docs([(1, None)])).collect()) == 1


def brute_votes(text):
    """The nine votes of a text, by plain string work."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, w, chars = len(words), max(len(words), 1), max(sum(map(len, words)), 1)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    grams = [tuple(words[i:i + 5]) for i in range(n - 4)]
    repeated = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    symbols, marks = sum(text.count(c) for c in "#*$%&|<>"), sum(text.count(c) for c in "!?")
    upper, letters = len(re.findall("[A-Z]", text)), sum(c.isascii() and c.isalpha() or ord(c) >= 0x80 for c in text)
    ends, distinct, k = sum(x[-1] in ".!?" for x in words), len(set(words)), max(len(lines), 1)

    def vote(good, bad):
        return wl.BAD if bad else wl.GOOD if good else wl.ABSTAIN
    some = n >= 20
    return [vote(n >= 50 and chars / w < 9, n < 3 or chars / w > 15), vote(some and not repeated, len(repeated) > 0.2 * w),
            vote(k >= 3 and dup == 0, dup > 0.3 * k), vote(some and symbols == 0, symbols > 0.1 * w),
            vote(some and letters > 0.9 * chars, letters < 0.75 * chars), vote(some and upper < 0.1 * chars, upper > 0.5 * chars),
            vote(some and marks < 0.05 * w, marks > 0.3 * w),
            vote(some and 0.02 * w <= ends <= 0.4 * w, n >= 40 and (ends == 0 or ends > 0.6 * w)),
            vote(n >= 30 and distinct >= 0.3 * w, n >= 30 and distinct < 0.1 * w)]


def test_votes_against_brute_force():
    rnd = random.Random(11)
    bits = ["word", "Other.", "THIRD!", "#x", "naïve", "12345", "a", "long" * 6, "b?", "same"]
    texts = ["", " \n ", "one", "a b"]
    for _ in range(120):
        pool = rnd.sample(bits, rnd.randrange(1, len(bits) + 1)) + [f"u{rnd.randrange(500)}" for _ in range(rnd.choice((0, 60)))]
        words = [rnd.choice(pool) for _ in range(rnd.choice((5, 25, 45, 90)))]
        texts.append("".join(x + rnd.choice((" ", " ", " ", "\n", "  ")) for x in words))
    got = [v for _, _, data, offsets in passes(pa.array(texts)) for v in wl.votes(data, offsets, Words(data, offsets)).tolist()]
    assert got == [brute_votes(t) for t in texts]


def test_estimates_against_plain_expectation_maximisation():
    """Every document for itself, with Python sums, the same rounds."""
    rnd = random.Random(3)
    docs = []
    for _ in range(400):
        good = rnd.random() < 0.7
        docs.append(tuple(wl.ABSTAIN if rnd.random() < 0.2 else (wl.GOOD if good else wl.BAD) if rnd.random() < a else (wl.BAD if good else wl.GOOD)
                          for a in (0.9, 0.8, 0.7, 0.6, 0.85)))
    patterns = sorted(set(docs))
    counts = [docs.count(p) for p in patterns]
    post, chance = wl.estimate(np.array(patterns), np.array(counts), rounds=7)

    need = min(wl.ENOUGH, len(docs[0]) // 2)
    belief = {p: 0.1 if wl.BAD in p else 0.9 for p in patterns}
    for _ in range(7):
        sure = [p for p in docs if sum(v != wl.ABSTAIN for v in p) >= need]
        weight = [sum(1 - belief[p] for p in sure), sum(belief[p] for p in sure)]
        table = [[[(sum((belief[p] if c else 1 - belief[p]) for p in sure if p[i] == v) + 1) / (weight[c] + 3) for v in range(3)]
                  for i in range(5)] for c in range(2)]
        prior = [(x + 1) / (len(sure) + 2) for x in weight]
        new = {}
        for p in patterns:
            whole = sum(v != wl.ABSTAIN for v in p) >= need
            like = [prior[c] * math.prod(table[c][i][v] if whole else 1 if v == wl.ABSTAIN else table[c][i][v] / (1 - table[c][i][wl.ABSTAIN])
                                         for i, v in enumerate(p)) for c in range(2)]
            new[p] = like[1] / sum(like)
        belief = new
    assert np.allclose(post, [belief[p] for p in patterns], atol=1e-9) and np.allclose(chance, table)
