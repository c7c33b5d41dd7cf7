"""Best-fit packing with dual-feasible bounds and repacking between partitions.

1. Tokenise: every text becomes pieces of at most ``capacity`` ids.
2. Pack: pieces are dealt into groups of a bounded number of pieces by a hash
   of their row number; each group runs best-fit decreasing and computes a
   lower bound on its bin count from dual-feasible functions. A group whose
   count meets its bound is certified optimal.
3. Exchange: groups that are not certified give up the pieces of their bins
   with gaps; these are dealt into fresh groups, mixed with those of the other
   groups, and packed again. A round that saves no bin is not used.

Groups hold a fixed number of pieces, so their number grows with the input and
no task sees more than ``group_items`` pieces (by expectation of the hash).

Null texts count as empty (one closing id, one piece); repeated rows are packed
as often as they occur; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.llm.common import inner_names, stage_table

PIECE_COLUMNS = "piece int, start long, length long, ids_crc32 long"
#: Bytes of encoded words that a task keeps, all caches together, and what an entry takes beside its texts.
CACHE_BYTES = 96 << 20
ENTRY_BYTES = 200


def _byte_level() -> list[str]:
    """Byte-level BPE's character of each byte: visible Latin-1 stands for itself, others follow from 256 on."""
    visible = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


_BYTE_LEVEL = _byte_level()
#: Characters of runs that are pre-tokens of their own behind letters; no apostrophe, which begins contractions.
MARKS = ".,;:!?#*$%&|<>"


class _Apart(Exception):
    """A word whose ids depend on the white space beside it."""


class WordEncoder:
    """Byte-level BPE ids of whole texts, as little-endian 32-bit bytes.

    A single space between two non-space characters always begins a new
    pre-token, as does a line feed between two, so words are encoded once and
    cached. Texts with other white space are cut only where that holds.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.held = 0
        self.spaced: dict[str, bytes] = _Cache(self, " ")
        self.bare: dict[str, bytes] = _Cache(self, "")
        self.newline = self.raw("\n")

    def forget(self) -> None:
        for cache in (self.spaced, self.bare):
            cache.clear()
            cache.older = {}
        self.held = 0

    def close(self) -> None:
        """Lets go of all: encoder and caches refer to each other, and Python would find that only long after."""
        self.forget()
        del self.spaced, self.bare, self.model, self.tokenizer

    def age(self) -> None:
        """The young generations become the old ones."""
        for cache in (self.spaced, self.bare):
            cache.older = dict(cache)
            cache.clear()
        self.held = 0

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def letters(self, text: str) -> bytes:
        """Ids of one pre-token: letters, with a space before them or none."""
        if text.isascii():                     # letters stand for themselves
            level = text.replace(" ", _BYTE_LEVEL[32])
        else:
            level = "".join(map(_BYTE_LEVEL.__getitem__, text.encode()))
        ids = [t.id for t in self.model.tokenize(level)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))
        except _Apart:
            pass
        # join chunks that meet at a space with other white space beside it
        chunks, spaces, out = text.split(" "), False, []
        run = chunks[0]
        for c in chunks[1:]:
            if run and c and not run[-1].isspace() and not c[0].isspace():
                out.append((spaces, run))
                run, spaces = c, True
            else:
                run += " " + c
        out.append((spaces, run))
        return b"".join(self.raw((" " if sp else "") + w) if any(ch.isspace() for ch in w)
                        else (self.spaced if sp else self.bare)[w] for sp, w in out)


class _Cache(dict):
    """Ids by word, in two generations: words not used for long are dropped."""

    def __init__(self, encoder: WordEncoder, lead: str):
        self.encoder, self.lead = encoder, lead
        self.older: dict[str, bytes] = {}

    def keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= 64:
            encoder = self.encoder
            encoder.held += ENTRY_BYTES + len(word) + len(ids)
            if encoder.held > CACHE_BYTES // 2:
                encoder.age()
            self[word] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is not None:
            return self.keep(word, ids)
        if word.isalpha():                     # so without white space
            return self.keep(word, self.encoder.letters(self.lead + word))
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Apart
        if "\n" in word:
            head, *lines = word.split("\n")
            bare = self.encoder.bare
            if not all(x and not x[0].isspace() and not x[-1].isspace() for x in (head, *lines)):
                return self.encoder.raw(self.lead + word)
            feed = self.encoder.newline
            return self[head] + b"".join(feed + bare[x] for x in lines)
        head = word.rstrip(MARKS)
        if len(head) < len(word) and head[-1:].isalpha():
            return self.keep(word, self[head] + self.encoder.bare[word[len(head):]])
        return self.keep(word, self.encoder.raw(self.lead + word))


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    head = length % capacity or capacity
    out = [(0, min(head, length))]
    while out[-1][0] + out[-1][1] < length:
        out.append((out[-1][0] + out[-1][1], capacity))
    return out


def tokenize_pieces(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text",
                    capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: the key column, piece, start, length, ids_crc32.

    ``tokenizer`` is the path of a byte-level BPE file, present on every node.
    """
    source = inner_names(docs, {key: "k", text: "t"})
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encoder = WordEncoder(tokenizer)
        try:
            for batch in batches:
                keys, rows = batch.column("k"), []
                for i, t in enumerate(batch.column("t")):
                    ids = encoder.encode(t.as_py() or "") + tail
                    for p, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((i, p, start, n, zlib.crc32(ids[4 * start:4 * (start + n)])))
                c = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(c[0], pa.int32())), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:])],
                    names=[key, "piece", "start", "length", "ids_crc32"])
        finally:                       # the worker serves other tasks and stages: reading the file again takes 0.15 s
            encoder.close()
            pa.system_memory_pool().release_unused()      # what malloc holds of it, too

    schema = T.StructType([T.StructField(key, source.schema["k"].dataType), *T._parse_datatype_string(PIECE_COLUMNS).fields])
    return source.mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the bin count.

    Open bins are kept by free space; a bit mask over the spaces finds the
    least one that is large enough.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for i in order.tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                mask &= ~(1 << space)
        else:
            space, b = capacity, count
            count += 1
        bins[i], offsets[i] = b, capacity - space
        left = space - n
        if left:
            by_space[left].append(b)
            mask |= 1 << left
    return bins, offsets, count


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of three families of dual-feasible functions.

    The identity, the threshold functions (large items count whole, items
    below the threshold not at all) and the rounding functions that take
    ``(k + 1) x`` down to a multiple of the capacity.
    """
    counts = np.bincount(lengths, minlength=capacity + 1)[:capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    items, weight = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * x)))
    a = np.arange(1, capacity // 2 + 1)
    whole = items[capacity + 1] - items[capacity - a + 1]
    middle = weight[capacity - a + 1] - weight[a]
    if len(a):
        best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(1, 33):
        y = (k + 1) * x
        scaled = np.where(y % capacity == 0, x * k, y // capacity * capacity)
        best = max(best, -(-int((counts * scaled).sum()) // (capacity * k)))
    return best


def _pack_groups(rows: DataFrame, round_no: int, groups: int, capacity: int) -> DataFrame:
    """Packs each group; adds group, bin, offset, fill, bins, bound."""
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("row", F.lit(round_no)), F.lit(groups)))
    extra = ["bin", "offset", "fill", "bins", "bound"]
    schema = T.StructType([*dealt.schema.fields, *[T.StructField(c, T.LongType()) for c in extra]])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")      # a task that runs again gives the same bins
        lengths = group.column("length").to_numpy()
        bins, offsets, count = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=count).astype(np.int64)
        whole = [np.full(len(lengths), v, dtype=np.int64) for v in (count, lower_bound(lengths, capacity))]
        for name, values in zip(extra, [bins, offsets, fill[bins], *whole]):
            group = group.append_column(name, pa.array(values))
        return group

    return dealt.groupBy("group").applyInArrow(run, schema)


def pack(pieces: DataFrame, *, capacity: int = 2048, length: str = "length", group_items: int = 20_000,
         rounds: int = 4, gap_share: float = 0.01) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to every piece.

    ``group_items``: pieces a group holds; ``rounds``: exchanges at most;
    ``gap_share``: share of the capacity from which a bin counts as having a
    gap. Lengths must be from 1 to ``capacity``. An input column named
    ``sequence_id`` or ``offset`` is replaced.
    """
    kept = [c for c in pieces.columns if c not in (length, "sequence_id", "offset")]
    named = inner_names(pieces, {c: f"p{i}" for i, c in enumerate(kept)} | {length: "length"})
    rows = stage_table(named.withColumn("length", F.col("length").cast("long")).withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // group_items))
    current = stage_table(_pack_groups(rows, 0, groups, capacity), "packed")
    done: list[DataFrame] = []
    open_bin = (F.col("bins") > F.col("bound")) & (F.col("fill") <= capacity * (1 - gap_share))
    while len(done) < rounds:
        gaps = current.where(open_bin)
        n, before = gaps.agg(F.count(F.lit(1)), F.count_distinct("group", "bin")).first()
        if not n:
            break
        groups = max(1, -(-n // group_items))
        again = stage_table(_pack_groups(gaps.select(*rows.columns), len(done) + 1, groups, capacity), "packed")
        if again.agg(F.count_distinct("group", "bin")).first()[0] >= before:
            break
        done.append(_numbered(current.where(~open_bin), len(done)))
        current = again
    done.append(_numbered(current, len(done)))
    out = reduce(DataFrame.unionByName, done)
    return out.select(*[F.col(f"p{i}").alias(c) for i, c in enumerate(kept)], F.col("length").alias(length), "sequence_id", "offset")


def _numbered(df: DataFrame, round_no: int) -> DataFrame:
    """Sequence numbers from (round, group, bin): unique without a global count."""
    return df.withColumn("sequence_id", F.shiftleft(F.lit(round_no).cast("long"), 56) + F.shiftleft(F.col("group"), 24) + F.col("bin"))


def best_fit_pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = 2048,
                  end_id: int = 0, group_items: int = 20_000, rounds: int = 4) -> DataFrame:
    """Documents to packed sequences: key, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenize_pieces(docs, tokenizer, key=key, text=text, capacity=capacity, end_id=end_id)
    out = pack(pieces, capacity=capacity, group_items=group_items, rounds=rounds)
    return out.select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
