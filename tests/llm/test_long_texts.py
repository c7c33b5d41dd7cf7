"""Texts far longer than one pass or one table of the hash functions, in every operator's text functions."""

import resource

import numpy as np
import pyarrow as pa

from covenant.llm import common as C
from covenant.llm import quality


def test_span_hashes_do_not_depend_on_the_position():
    rng = np.random.default_rng(1)
    word = rng.integers(33, 90, 500).astype(np.uint8)
    data = rng.integers(33, 90, 3 * C.HASH_BLOCK + 77).astype(np.uint8)
    places = [0, 5, C.HASH_BLOCK - 250, C.HASH_BLOCK, 2 * C.HASH_BLOCK - 1, len(data) - 500]
    for p in places:
        data[p:p + 500] = word
        spans = C.Spans(data)
        starts = np.array([p])
        assert spans.hash(starts, starts + 500)[0] == C.Spans(word).hash(np.array([0]), np.array([500]))[0]


def test_twenty_megabytes_leave_nothing_behind():
    """One 20 MB text takes memory in proportion, and the tables stay as long as a block."""
    text = " ".join(f"w{i % 9973}" for i in range(3_600_000))
    assert len(text) > 20_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = quality.measure_column(pa.array([text, "a b", None])).to_pylist()
    peak = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1e3
    assert [r["n_words"] for r in got] == [3_600_000, 2, 0] and got[0]["n_repeat_words"] == 3_600_000
    assert len(C._POWERS) == len(C._INVERSE) == C.HASH_BLOCK
    assert peak < 1500, peak


def test_word_caches_are_bounded_and_dropped(monkeypatch):
    import public_tokenizers

    from covenant.llm import packing
    monkeypatch.setattr(packing, "CACHE_BYTES", 200_000)
    encoder = packing.WordEncoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    text = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efghijklmn'[i // 1000 % 10]}" for i in range(9000))
    assert encoder.encode(text) == encoder.raw(text)
    assert sum(len(c) + len(c.older) for c in (encoder.spaced, encoder.bare)) < 1100
    encoder.forget()
    assert not encoder.spaced and not encoder.spaced.older and encoder.held == 0
