import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from covenant.llm import lm
from covenant.llm.lm import CONTEXT, Model, initial, lm_scores, log_probabilities

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def brute(rows):
    counts = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n,
             sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(x))) for i, x in rows]


def corpus():
    rnd = random.Random(12)
    sides = [[f"{s}{i}" for i in range(150)] for s in "ab"]
    rows = []
    for i in range(800):
        pool = sides[i % 2]
        rows.append((100 + i, " ".join(pool[min(int(rnd.expovariate(0.03)), 149)] for _ in range(rnd.randint(5, 80))).title()))
    return rows


@pytest.mark.parametrize("head", [lm.HEAD, 40])
def test_base_against_brute_force(make_docs, odd_rows, head):
    rows = odd_rows + corpus()[:300] + [(5000 + i, f"only{i} here{i}") for i in range(20)]
    got = [tuple(r) for r in lm_scores(make_docs(rows), head=head, common=30).collect()]
    want = brute(rows)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert g[:5] == w[:5]
    by = sorted(((g[0] is None, g[0] or 0, g[2], g[5]) for g in got))
    for g, w in zip(by, sorted((w[0] is None, w[0] or 0, w[2], w[5]) for w in want)):
        assert abs(g[3] - w[3]) <= 1e-6 * max(1, abs(w[3]))
    assert all(math.isfinite(g[6]) and g[6] < 0 for g in got)


def test_model_beats_the_unigram_on_held_out_texts(make_docs, monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 128)
    out = [r for r in lm_scores(make_docs(corpus() * 4)).collect() if r.held_out]
    assert len(out) > 100
    assert sum(r.score for r in out) > 0.95 * sum(r.base_score for r in out)      # log probabilities: less is better


def test_probabilities_are_normalised():
    rng = np.random.default_rng(3)
    m = initial(rng.integers(1, 50, 150).astype(float))
    m = Model(*(x + rng.normal(0, 0.5, x.shape).astype(np.float32) for x in m.parts()))
    ctx = rng.integers(0, 150, (CONTEXT, 1))
    every = log_probabilities(m, np.repeat(ctx, 150, axis=1), np.arange(150))
    assert abs(np.exp(every).sum() - 1) < 1e-4


def test_empty(make_docs):
    assert lm_scores(make_docs([])).collect() == []
    r = lm_scores(make_docs([(i, "a b") for i in range(200) if held(i)][:1])).first()
    assert r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0


def test_every_word_has_a_place_and_buckets_share_all_of_it(spark, make_docs):
    """Common words and buckets: each bucket's shares, and one unseen word's, add up to one."""
    rows = corpus()[:200] + [(5000 + i, f"only{i} here{i // 2}") for i in range(300)]
    docs = make_docs(rows, extra=False)
    lexicon = lm.read_lexicon(lm._counts(docs), common=20)
    counts = Counter(t for _, x in rows for t in tokens(x))
    words = sorted(w for w in counts if w)
    from covenant.llm.common import SPACE, Words
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    h = Words(data, np.array([0, len(data)]), SPACE).hash
    place, found = lexicon.find(h)
    assert found.all() and lexicon.distinct == len(counts)
    model_word = lexicon.words[place]
    common = {w for w, m in zip(words, model_word) if m < lexicon.first_bucket}
    assert len(common) == 20 and min(counts[w] for w in common) >= max(counts[w] for w in words if w not in common)
    total = np.ones(1 << lexicon.bits)
    for w, m in zip(words, model_word):
        if m >= lexicon.first_bucket:
            total[m - lexicon.first_bucket] += counts[w] + 1
    assert np.allclose(np.log10(total), lexicon.bucket_log)
    assert lexicon.unigram.sum() == sum(counts.values())


def test_the_model_grows_with_the_words(make_docs):
    sizes = []
    for n in (50, 800, 12_800):
        sizes.append(len(lm.read_lexicon(lm._counts(make_docs([(i, f"w{i} v{i}") for i in range(n)], extra=False)), common=10).unigram))
    assert sizes[0] < sizes[1] < sizes[2]
