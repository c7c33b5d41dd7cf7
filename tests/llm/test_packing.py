import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from covenant.llm.packing import best_fit_decreasing, best_fit_pack, cut, lower_bound, pack
from covenant.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def check(rows, out, tok, capacity):
    """Round trip: pieces rebuild every document's ids; sequences are gapless."""
    want = sorted((i is None, i or 0, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    assert [g[1:] for g in got] == [(i, *rest) for (_, i, *rest) in sorted(
        (none, i, p, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())) for none, i, ids in want for p, (s, n) in enumerate(cut(len(ids), capacity)))]
    seqs = defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for spans in seqs.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_round_trip_and_odd_rows(make_docs, odd_rows, tok):
    rows = odd_rows + [(100 + i, f"word{i} " * (i % 90) + "tail, the <|endoftext|> end.\n\nNew  line don't 12,5%") for i in range(300)]
    out = best_fit_pack(make_docs(rows), tokenizer_path(), capacity=256, group_items=60).collect()
    n = check(rows, out, tok, 256)
    lengths = np.array([r.length for r in out])
    assert lower_bound(lengths, 256) <= n <= 1.08 * lower_bound(lengths, 256) + 1


def test_only_the_first_piece_is_shorter():
    assert cut(2048, 2048) == [(0, 2048)]
    assert cut(2049, 2048) == [(0, 1), (1, 2048)]
    assert cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]


def test_bounds_hold_and_certify():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        _, _, bins = best_fit_decreasing(sizes, 100)
        assert -(-sizes.sum() // 100) <= lower_bound(sizes, 100) <= bins
    assert lower_bound(np.array([51] * 7), 100) == 7          # the sum alone gives 4
    assert lower_bound(np.array([34] * 9), 100) == 5          # two in a bin
    assert best_fit_decreasing(np.array([60, 60, 40, 40]), 100)[2] == 2


def test_exchange_saves_bins(spark):
    rng = np.random.default_rng(5)
    sizes = [(int(x),) for x in rng.integers(1, 300, 2000)]
    df = spark.createDataFrame(sizes, "length long").repartition(4)
    alone = pack(df, capacity=512, group_items=25, rounds=0).select("sequence_id").distinct().count()
    mixed = pack(df, capacity=512, group_items=25, rounds=4)
    assert mixed.count() == 2000
    assert mixed.select("sequence_id").distinct().count() < alone


def test_empty(make_docs):
    assert best_fit_pack(make_docs([]), tokenizer_path()).collect() == []


def test_words_before_marks_are_not_encoded_as_texts(tok, monkeypatch):
    """Letters and the marks behind them are two pre-tokens; the marks are encoded once."""
    from covenant.llm.packing import WordEncoder
    encoder, seen = WordEncoder(tokenizer_path()), []
    monkeypatch.setattr(encoder, "raw", lambda t, raw=encoder.raw: seen.append(t) or raw(t))
    text = " ".join(f"{w}{m}" for w in ("alpha", "Żółw", "naïve", "x") for m in ("$$$", "***", ",%%", "!?", "'s.", "."))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert all("'" in t or t.strip("$*,%!?.\n") == "" for t in seen)


def test_a_closed_encoder_is_freed_at_once():
    """A worker serves many tasks, each with an encoder of its own: none may wait for Python's search for cycles."""
    import gc
    import weakref

    from covenant.llm.packing import WordEncoder
    encoder = WordEncoder(tokenizer_path())
    encoder.encode("some words, some more")
    left = weakref.ref(encoder)
    gc.disable()
    try:
        encoder.close()
        del encoder
        assert left() is None
    finally:
        gc.enable()
