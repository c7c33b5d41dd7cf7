"""SimHash near-duplicates by a grid join on segment bit counts.

1. Every text gets a 64-bit fingerprint: bit ``i`` is set if it is set in over
   half of the XXH64 values of the text's word shingles.
2. Equal fingerprints are one node with the least document id.
3. A fingerprint is mapped to the bit counts of its segments. The Manhattan
   distance of two such vectors is at most the Hamming distance of the
   fingerprints, so all links lie within distance 2 of each other on the grid of
   vectors. Two points within distance 2 have a grid point within distance 1 of
   both: every fingerprint is entered in its own cell and in those one step away,
   and fingerprints that meet in a cell are compared exactly.
4. Cells with over ``CELL_ROWS`` entries are not joined. Their fingerprints are
   entered again on the finest grid, one bit a segment, where a cell holds at most
   65 fingerprints, so no cell's pairs grow with a group of copies.
5. Components of the links; each takes its least document id.

Texts without words have fingerprint 0 and link like any other; null texts count
as empty. Every row is returned, repeated rows too. Null ids count for no
component's least id; a component of such rows alone has a null id. An empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.llm.common import SPACE, Words, inner_names, passes, stage_table
from covenant.llm.graph import components

SEED = 42
DISTANCE = 2
#: Segments of the coarse grid, and the fingerprints from which segments are halved.
SEGMENTS = 16
HALVE_FROM = 50_000_000
#: Entries of a cell up to which they are compared with each other.
CELL_ROWS = 256
#: Shingles handled at once.
CHUNK = 1 << 17


def _shingle_ranges(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and last word of every shingle; texts of fewer words are one."""
    count = np.where(w.per_doc >= k, w.per_doc - k + 1, np.minimum(w.per_doc, 1))
    doc = np.repeat(np.arange(w.n_docs), count)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + w.first[doc]
    return doc, first, np.minimum(first + k, w.first[doc + 1]) - 1


def fingerprints(data: np.ndarray, offsets: np.ndarray, k: int = 3) -> np.ndarray:
    """The 64-bit fingerprint of every text of one pass."""
    w = Words(data, offsets, SPACE, lower=True)
    size = w.end - w.start
    # all words again, one space between them: a shingle is one range of these bytes
    at = np.concatenate(([0], np.cumsum(size + 1)))
    joined = np.full(at[-1], 0x20, dtype=np.uint8)
    inside = np.ones(len(joined), dtype=bool)
    inside[at[1:] - 1] = False
    joined[inside] = w.data[~SPACE[w.data]]
    buffer = memoryview(joined.tobytes())
    doc, first, last = _shingle_ranges(w, k)
    total, ones = np.zeros(w.n_docs, dtype=np.int64), np.zeros((w.n_docs, 64), dtype=np.int64)
    h64 = xxhash.xxh64_intdigest
    for lo in range(0, len(doc), CHUNK):
        part = slice(lo, lo + CHUNK)
        starts, ends = at[first[part]], at[last[part]] + size[last[part]]
        h = np.fromiter((h64(buffer[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), dtype="<u8", count=len(starts))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        here, begin = np.unique(doc[part], return_index=True)
        ones[here] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
        total[here] += np.diff(np.append(begin, len(h)))
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def signed_fingerprints(text: pa.Array) -> pa.Array:
    """Fingerprints as signed numbers with the same bits."""
    found = [fingerprints(data, offsets) for _, _, data, offsets in passes(text)]
    return pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))


def segment_counts(fingerprint: Column, segments: int) -> list[Column]:
    """Bit count of each segment of consecutive bits."""
    width = 64 // segments
    mask = F.lit((1 << width) - 1).cast("long")
    return [F.bit_count(F.shiftrightunsigned(fingerprint, width * i).bitwiseAND(mask)) for i in range(segments)]


def _entries(prints: DataFrame, segments: int) -> DataFrame:
    """(cell, f): each fingerprint in its own cell and in all cells one step away."""
    width = 64 // segments
    if width == 1:
        steps = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
        return prints.select("f", F.explode(F.transform(steps, lambda x: F.col("f").bitwiseXOR(x))).alias("cell"))
    # counts are digits of one number: a step is a power of the base; cells beyond the counts' range merely stay empty
    counts = segment_counts(F.col("f"), segments)
    base = width + 3
    half = segments // 2
    number = lambda digits: sum(((d + 1).cast("long") * F.lit(base ** i) for i, d in enumerate(digits)), F.lit(0).cast("long"))
    low, high = number(counts[:half]), number(counts[half:])
    places = [base ** i for i in range(half)]
    steps = [(0, 0), *[(s * p, 0) for p in places for s in (1, -1)], *[(0, s * p) for p in places for s in (1, -1)]]
    table = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in steps])
    own = prints.select("f", low.alias("low"), high.alias("high"))
    return (own.select("f", "low", "high", F.explode(table).alias("s"))
            .select("f", F.xxhash64(F.col("low") + F.col("s.a"), F.col("high") + F.col("s.b")).alias("cell")))


def _meet(entries: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) between fingerprints of one cell, compared exactly.

    Spark sizes the entries like the fingerprints that they were exploded from, 33 or
    65 times too small, and would broadcast them through the driver; so the join is named.
    """
    a, b = entries.select("cell", F.col("f").alias("u")), entries.select("cell", F.col("f").alias("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)
    return a.hint("merge").join(b.hint("merge"), "cell").where(near).select("u", "v")


def fingerprint_links(prints: DataFrame, *, distance: int = DISTANCE, segments: int | None = None,
                      cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (u, v), u < v, of distinct fingerprints ``f`` at most ``distance`` (0 to 2) bits apart."""
    if not 0 <= distance <= 2:
        raise ValueError("a common cell is certain up to two bits")
    if segments is None:
        segments = SEGMENTS if prints.count() < HALVE_FROM else 2 * SEGMENTS
    entries = _entries(prints, segments)
    full = entries.groupBy("cell").count().where(F.col("count") > cell_rows).select("cell")
    links = _meet(entries.join(full, "cell", "left_anti"), distance)
    crowded = entries.join(full, "cell", "left_semi").select("f").distinct()
    return links.union(_meet(_entries(crowded, 64), distance)).distinct()


def simhash_fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, f): the key and the fingerprint, as a signed number, of every row."""
    rows = inner_names(docs, {key: "k", text: "t"})
    return rows.select("k", F.arrow_udf(signed_fingerprints, T.LongType())(F.coalesce("t", F.lit(""))).alias("f"))


def simhash_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The key, fingerprint (16 hex digits) and component_id of every row."""
    rows = stage_table(simhash_fingerprints(docs, key=key, text=text), "simhash")
    nodes = stage_table(rows.groupBy("f").agg(F.min("k").alias("least")), "simhash-nodes")
    part = components(fingerprint_links(nodes.select("f"), distance=distance))
    linked = nodes.join(part, nodes["f"] == part["node"], "left").select("f", "least", F.coalesce("component", "f").alias("c"))
    ids = linked.groupBy("c").agg(F.min("least").alias("component_id"))
    ids = linked.join(ids, "c").select("f", "component_id")
    return rows.join(ids, "f").select(F.col("k").alias(key), F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
