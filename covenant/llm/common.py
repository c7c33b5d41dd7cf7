"""Shared helpers of the training-data operators.

* ``stage_table`` cuts lineage by writing Parquet below the shared checkpoint
  folder (``spark.checkpoint.dir``), so a lost executor costs a re-read only;
  ``temporary_tables`` removes the tables of a block at its end.
* ``Words`` finds and hashes the words of a batch of texts with numpy passes
  over the Arrow buffers: no Python object per word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.session import checkpoint_dir

#: Separators of ``[^\x20\x09-\x0D]+`` words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` words (after lower-casing).
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x61:0x7B] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text handled by one numpy pass (a single longer text is one pass):
#: its arrays stay in the processor's cache and a worker's memory small.
PASS_BYTES = 1 << 17

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
#: Bytes of one block of the hash tables; longer data reuse them with a factor per block.
HASH_BLOCK = 1 << 18


def _powers(base: np.uint64) -> np.ndarray:
    p = np.full(HASH_BLOCK, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p)


_POWERS, _INVERSE = _powers(_P), _powers(_P_INV)


def _block_factors(base: np.uint64, blocks: int) -> np.ndarray:
    step = pow(int(base), HASH_BLOCK, 1 << 64)
    return np.array([pow(step, b, 1 << 64) for b in range(blocks)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads a 64-bit key over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """64-bit hashes of any byte ranges of ``data`` in O(1) each.

    Holds one 64-bit prefix a byte; all tables have the length of one block.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        blocks = n // HASH_BLOCK + 1
        self.undo = _block_factors(_P_INV, blocks)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        for b, factor in enumerate(_block_factors(_P, blocks)):
            lo, hi = b * HASH_BLOCK, min(n, (b + 1) * HASH_BLOCK)
            part = (data[lo:hi].astype(np.uint64) + np.uint64(1)) * _POWERS[:hi - lo] * factor
            np.cumsum(part, out=self.prefix[lo + 1:hi + 1])
            self.prefix[lo + 1:hi + 1] += self.prefix[lo]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.prefix[end] - self.prefix[start]) * _INVERSE[start % HASH_BLOCK] * self.undo[start // HASH_BLOCK]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Words of several texts: ``start``/``end`` bytes, ``doc`` index, ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        self.n_docs = len(offsets) - 1
        n = len(data)
        inside = ~separators[self.data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        prev = np.empty(n, dtype=bool)
        prev[:1] = False
        prev[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~prev | first[:n]))
        after = np.empty(n, dtype=bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.doc = np.searchsorted(offsets[1:], self.start, side="right")
        self.per_doc = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.concatenate(([0], np.cumsum(self.per_doc)))
        self.spans = Spans(self.data)
        self.hash = self.spans.hash(self.start, self.end)

    def text(self, i: int, j: int) -> str:
        """Words ``i`` to ``j`` (exclusive), joined by one space."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j])).decode("utf-8", "replace")


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive entries (across document borders too)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * _P + hashes[j:j + n]
    return mix(out)


def passes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts an Arrow text column into runs of at most ``PASS_BYTES`` bytes.

    Yields (first row, end row, bytes, offsets); null texts are empty. A text
    longer than that is a run of its own: texts are never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    column = column.fill_null("").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PASS_BYTES, side="right")) - 1)
        a, b = int(offsets[lo]), int(offsets[hi])
        yield lo, hi, data[a:b], offsets[lo:hi + 1] - a
        lo = hi


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


#: Paths written inside the open blocks of ``temporary_tables``, innermost last.
_BLOCKS: ContextVar[tuple[list[str], ...]] = ContextVar("temporary_tables", default=())


def stage_table(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """Writes ``df`` below the shared checkpoint folder and reads it back.

    ``keep``: the table outlives the block of ``temporary_tables`` that it is written in.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    blocks = _BLOCKS.get()[:-1] if keep else _BLOCKS.get()
    if blocks:
        blocks[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Removes the staged tables of the block at its end; what leaves it must read only kept ones."""
    paths: list[str] = []
    outer = _BLOCKS.set((*_BLOCKS.get(), paths))
    try:
        yield
    finally:
        _BLOCKS.reset(outer)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bitmap(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """Packed bitmap of ``2 ** bits`` places: the low bits of the column's values.

    Put together in blocks of 4 kB by Spark, so the driver gathers the bitmap and no value.
    """
    place = F.col(column).bitwiseAND((1 << bits) - 1) + 1           # Spark numbers places from 1
    blocks = rows.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((max(1, (1 << bits) >> 15), 4096), dtype=np.uint8)
    for r in blocks.collect():
        out[r.block - 1] = np.frombuffer(r.bits, np.uint8)
    return np.packbits(np.unpackbits(out.ravel(), bitorder="little"))


def inner_names(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Only the columns asked for, under private names.

    The operators work on these, so other columns of the input may have any
    name, also one that an operator uses for its results.
    """
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in mapping.items()])


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)
