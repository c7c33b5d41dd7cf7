"""N-gram Jaccard join by a blocked sparse matrix product.

Documents are rows of a sparse incidence matrix, word n-grams (64-bit hashes)
its columns. The product of the matrix with its transpose holds the overlap
counts; it is taken only over tiles that can hold a link.

1. Equal sets are one class; the rest works on one row per class.
2. Size-derived bounds. Rows that link share at least t of the larger row's
   n-grams, so of any order of the columns, the first ``n - ceil(t n) + 1``
   columns of two linked rows have one in common, and for the smaller row it
   is among its first ``n - ceil(2t/(1+t) n) + 1``; only rows that share such a
   column meet, and places in the order bound what they can share behind it. The
   order is by rarity, so common passages come last: document counts are added up
   over all documents in a sketch of ``CELLS`` counters. Its errors only change the
   order, which is the same for all rows.
3. Rows also carry, for buckets in proportion to their size, whether an odd number of
   their columns falls into each. A bucket that is odd in one row of a pair only holds a
   column that only one of them has; this bounds the overlap, and pairs
   below the bound that their sizes ask for are discarded before any set moves.
4. Tiles. The rows that meet in a column are multiplied with the least of
   them, first each row with the one it meets most often: overlaps are
   accumulated over column blocks, and a pair is discarded as soon as its count
   and what is left cannot reach the bound.
5. Links form components; pairs inside one are not multiplied again. Where all
   rows of a column are in one component, no other pair is needed; where at most
   ``DIRECT`` rows meet, the pairs between components are multiplied; else the least
   rows of ``PEELS`` components are taken as in 4, all at once, and then what is left
   is multiplied. So no link between different components is lost, and groups of near copies do not form
   all their pairs; rows of different components that share a rare column all meet.

n-grams are compared by 64-bit hashes of whole n-grams.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from covenant.llm.common import SPACE, Words, bitmap, inner_names, mix, passes, shingles, small_enough, stage_table, temporary_tables
from covenant.llm.graph import components

#: Counters of the rarity sketch (16 bits each, 2 MB), and its blocks when summed.
CELLS = 1 << 20
SKETCH_BLOCKS = 64
#: Least buckets a column of the counts that bound overlaps (a bit each), and most a row: 8 kB.
BUCKETS = 1
MOST_BUCKETS = 1 << 16
#: Rows multiplied with one row in a tile.
TILE = 256
#: Columns of a block of the product.
COLUMNS = 2048
#: Rows that meet in a column up to which all their pairs are multiplied.
DIRECT = 256
#: Rows, of as many components, taken from larger meetings before the rest is multiplied at once.
PEELS = 4
#: Bits of the bitmap that lets sets of candidates through; 512 kB.
BITS = 22
#: Classes with a decision up to which these are broadcast (about 40 bytes each).
BROADCAST_CLASSES = 500_000

_SALT = np.uint64(0xA24BAED4963EE407)


def row_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of the distinct n-grams by document and hash, and set sizes.

    Fewer words than ``n`` are one n-gram; no words, none.
    """
    start = np.flatnonzero(w.doc[:len(w.doc) - n + 1] == w.doc[n - 1:]) if len(w.doc) >= n else np.zeros(0, np.int64)
    doc, h = w.doc[start], shingles(w.hash, n)[start] if len(start) else np.zeros(0, np.uint64)
    short = np.flatnonzero((w.per_doc > 0) & (w.per_doc < n))
    if len(short):
        whole = np.array([shingles(w.hash[w.first[d]:w.first[d + 1]], int(w.per_doc[d]))[0] for d in short], dtype=np.uint64)
        doc, h = np.concatenate((doc, short)), np.concatenate((h, mix(whole + w.per_doc[short].astype(np.uint64))))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[first], h[first]
    return doc, h, np.bincount(doc, minlength=w.n_docs)


def _sums(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.uint64)
    np.add.at(out, doc, values)
    return out


def digests(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    return _sums(doc, mix(h), n), _sums(doc, mix(h ^ _SALT), n)


def _cells(h: np.ndarray) -> np.ndarray:
    return (mix(h + _SALT) & np.uint64(CELLS - 1)).astype(np.int64)


def rarity_sketch(rows: DataFrame, n: int) -> np.ndarray:
    """Document counts of all n-grams, by cell, saturating.

    Every task sends its counters in compressed blocks; blocks are added up in
    two steps, so no task adds up more than about the root of the task count.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in passes(batch.column("text")):
                _, h, _ = row_sets(Words(data, offsets, SPACE, lower=True), n)
                cell, times = np.unique(_cells(h), return_counts=True)
                sketch[cell] += times
        yield _packed(sketch, int(np.random.default_rng().integers(1 << 20)))

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.uint16).astype(np.int64) for x in group.column("counters"))
        return pa.table({"block": group.column("block")[:1], "part": group.column("part")[:1],
                         "counters": pa.array([zlib.compress(np.minimum(total, 65535).astype(np.uint16).tobytes(), 1)])})

    schema = "block int, part int, counters binary"
    parts = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    sent = rows.select("text").mapInArrow(run, schema).withColumn("part", F.pmod("part", F.lit(parts)))
    summed = sent.groupBy("block", "part").applyInArrow(add, schema).withColumn("part", F.lit(0)).groupBy("block", "part").applyInArrow(add, schema)
    out = np.zeros((SKETCH_BLOCKS, CELLS // SKETCH_BLOCKS), dtype=np.uint16)
    for r in summed.collect():                     # SKETCH_BLOCKS rows, 2 MB
        out[r.block] = np.frombuffer(zlib.decompress(r.counters), np.uint16)
    return out.ravel()


def _packed(sketch: np.ndarray, part: int) -> pa.RecordBatch:
    blocks = np.minimum(sketch, 65535).astype(np.uint16).reshape(SKETCH_BLOCKS, -1)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(SKETCH_BLOCKS, dtype=np.int32)), pa.array(np.full(SKETCH_BLOCKS, part, np.int32)),
                                       pa.array([zlib.compress(b.tobytes(), 1) for b in blocks])], names=["block", "part", "counters"])


def prefixes(doc: np.ndarray, h: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, n-gram): the first ``size - ceil(t size) + 1`` n-grams of each row, rarest first."""
    rank = (sketch[_cells(h)].astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    order = np.lexsort((rank, doc))              # stable, and h is sorted: ties are by h
    doc, h = doc[order], h[order]
    place = np.arange(len(doc)) - np.concatenate(([0], np.cumsum(sizes)))[doc]
    take = place < (sizes - -(-sizes * num // den) + 1)[doc]
    return doc[take], h[take]


def bucket_counts(doc: np.ndarray, h: np.ndarray, n: int) -> list[bytes]:
    """Each row's size (8 bytes) and its columns by bucket, modulo 2, one bit a bucket.

    Buckets are a power of two and go by the low bits of a hash, so the halves of
    a longer row's bits, combined by exclusive or, are its bits for half the buckets.
    """
    sizes = np.bincount(doc, minlength=n)
    wide = np.ceil(np.log2(np.maximum(sizes * BUCKETS, 8))).astype(np.int64)
    buckets = np.minimum(np.int64(1) << wide, MOST_BUCKETS)
    first = np.concatenate(([0], np.cumsum(buckets)))
    at = first[doc] + (mix(h ^ _SALT) & (buckets[doc] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=first[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [int(size).to_bytes(8, "little") + odd[a:b] for size, a, b in zip(sizes, first // 8, first[1:] // 8)]


def _folded(odd: bytes, width: int) -> int:
    out = 0
    for a in range(0, len(odd), width):
        out ^= int.from_bytes(odd[a:a + width], "little")
    return out


def overlap_bounds(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Most columns that each pair of rows can share, by their bucket counts; no bound without both."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for i, (x, y) in enumerate(zip(a, b)):
        if x and y:
            width = min(len(x), len(y)) - 8
            apart = (_folded(x[8:], width) ^ _folded(y[8:], width)).bit_count()
            out[i] = (int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little") - apart) // 2
    return out


def _lists(doc: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _incidence(rows: DataFrame, n: int, sketch: np.ndarray, num: int, den: int) -> DataFrame:
    """row, key, size, d1, d2, bucket counts and the prefix of every document."""
    shared = rows.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column("text")):
                w = Words(data, offsets, SPACE, lower=True)
                doc, h, sizes = row_sets(w, n)
                d1, d2 = digests(doc, h, w.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, hi - lo), batch.column("key").slice(lo, hi - lo), pa.array(sizes.astype(np.int64)),
                     pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(bucket_counts(doc, h, w.n_docs), pa.binary()),
                     _lists(*prefixes(doc, h, sizes, shared.value, num, den), w.n_docs)],
                    names=["row", "key", "size", "d1", "d2", "buckets", "prefix"])

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", rows.schema["key"].dataType),
                           *T._parse_datatype_string("size long, d1 long, d2 long, buckets binary, prefix array<long>").fields])
    return rows.select("row", "key", "text").mapInArrow(run, schema)


def _sets(rows: DataFrame, n: int, packed: np.ndarray) -> DataFrame:
    """d1, d2, size, grams: the sets whose digest the bitmap lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sent = np.unpackbits(packed).astype(bool), set()       # sent: digests, so copies in a task go once
        for batch in batches:
            for _, _, data, offsets in passes(batch.column("text")):
                w = Words(data, offsets, SPACE, lower=True)
                doc, h, sizes = row_sets(w, n)
                d1, d2 = digests(doc, h, w.n_docs)
                keep = bits[(d1 & np.uint64((1 << BITS) - 1)).astype(np.int64)] & (sizes > 0)
                for i in np.flatnonzero(keep).tolist():
                    digest = (int(d1[i]), int(d2[i]))
                    keep[i] = digest not in sent
                    sent.add(digest)
                new = np.cumsum(keep) - 1
                own = keep[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d1[keep].view(np.int64)), pa.array(d2[keep].view(np.int64)), pa.array(sizes[keep].astype(np.int64)),
                     _lists(new[doc[own]], h[own], int(keep.sum()))], names=["d1", "d2", "size", "grams"])

    return rows.select("text").mapInArrow(run, "d1 long, d2 long, size long, grams array<long>")


def tile_overlaps(pivot: np.ndarray, lists: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Overlap of each list with ``pivot``; -1 for pairs discarded on the way.

    All arrays are sorted and distinct. Columns are taken in blocks of
    ``COLUMNS`` of the pivot's range.
    """
    sizes = np.array([len(x) for x in lists])
    need = -(-(sizes + len(pivot)) * num // (num + den))      # least overlap of a linked pair
    alive = (np.minimum(sizes, len(pivot)) >= need)
    count = np.zeros(len(lists), dtype=np.int64)
    done = np.zeros(len(lists), dtype=np.int64)
    for lo in range(0, len(pivot), COLUMNS):
        block = pivot[lo:lo + COLUMNS]
        last = lo + COLUMNS >= len(pivot)
        live = np.flatnonzero(alive)
        if not len(live):
            break
        parts = []
        for i in live:
            x = lists[i]
            end = len(x) if last else int(np.searchsorted(x, block[-1], side="right"))
            parts.append(x[done[i]:end])
            done[i] = end
        flat = np.concatenate(parts)
        owner = np.repeat(live, [len(p) for p in parts])
        at = np.minimum(np.searchsorted(block, flat), len(block) - 1)
        count += np.bincount(owner[block[at] == flat], minlength=len(lists))
        left = np.minimum(sizes - done, len(pivot) - min(lo + COLUMNS, len(pivot)))
        alive &= count + left >= need
    return np.where(alive & (count >= need), count, -1)


def _sets_of(pairs: DataFrame, rows: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(row, grams) of those of ``rows`` that are in a pair, read from the texts."""
    wanted = pairs.select("row").union(pairs.select("pivot")).distinct().join(rows.select("row", "d1", "d2", "size"), "row")
    wanted = stage_table(wanted, "wanted-sets")
    packed = bitmap(wanted, "d1", BITS)
    if not packed.any():
        return docs.sparkSession.createDataFrame([], "row long, grams array<long>")
    found = _sets(docs, n, packed).join(wanted, ["d1", "d2", "size"])
    return stage_table(found.groupBy("d1", "d2", "size", "row").agg(F.any_value("grams").alias("grams")).select("row", "grams"), "sets")


def _possible(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (row, pivot, ...) that sizes and bucket counts allow to link."""
    names = pairs.columns
    side = rows.select("row", "size", "buckets")
    other = rows.select(F.col("row").alias("pivot"), F.col("size").alias("other_size"), F.col("buckets").alias("other_buckets"))
    both = (pairs.join(side, "row").where(F.col("row") != F.col("pivot")).join(other, "pivot")
            .where(F.least("size", "other_size") * den >= F.greatest("size", "other_size") * num))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                most = overlap_bounds(batch.column("buckets").to_pylist(), batch.column("other_buckets").to_pylist())
                total = batch.column("size").to_numpy() + batch.column("other_size").to_numpy()
                batch = batch.filter(pa.array(most >= -(-total * num // (num + den))))
            yield batch.select(names)

    return both.select(*names, "size", "other_size", "buckets", "other_buckets").mapInArrow(run, pairs.schema)


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Linked (u, v, overlap) of the candidate pairs (row, pivot), by tiles of the product."""
    tiles = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("long").alias("tiles"))
    pairs = pairs.join(tiles, "pivot").select("pivot", "row", F.pmod(F.xxhash64("row"), "tiles").alias("tile"))
    heads = tiles.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), F.col("pivot").alias("row"))
    members = pairs.select("pivot", "tile", "row").union(heads.select("pivot", "tile", "row")).join(sets, "row").select("pivot", "tile", "row", "grams")

    def run(tile: pa.Table) -> pa.Table:
        rows, pivot = tile.column("row").to_numpy(), tile.column("pivot")[0].as_py()
        grams = tile.column("grams").combine_chunks()
        lists = [np.sort(g.values.to_numpy(zero_copy_only=False).view(np.uint64)) for g in grams]
        head = lists[int(np.flatnonzero(rows == pivot)[0])]
        others = np.flatnonzero(rows != pivot)
        overlap = tile_overlaps(head, [lists[i] for i in others], num, den) if len(others) else np.zeros(0, np.int64)
        hit = overlap >= 0
        return pa.table({"u": pa.array(rows[others][hit]), "v": pa.array(np.full(int(hit.sum()), pivot, np.int64)), "overlap": pa.array(overlap[hit])})

    return members.groupBy("pivot", "tile").applyInArrow(run, "u long, v long, overlap long")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (row, pivot) whose rows are in different components."""
    out = pairs.join(comps.select(F.col("node").alias("row"), F.col("component").alias("a")), "row", "left")
    out = out.join(comps.select(F.col("node").alias("pivot"), F.col("component").alias("b")), "pivot", "left")
    return out.where(F.coalesce("a", "row") != F.coalesce("b", "pivot")).select("row", "pivot")


def _with_links(comps: DataFrame, pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Components after the links among ``pairs`` are added."""
    if pairs.isEmpty():
        return comps
    new = stage_table(_links(pairs, sets, num, den), "links").select("u", "v")
    if new.isEmpty():
        return comps
    return components(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).union(new))


def classes_and_components(docs: DataFrame, *, key: str, text: str, shingle: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows have row, key, size, d1, d2; classes d1, d2, size, rep, least_key, copies, component."""
    with temporary_tables(docs.sparkSession):
        return _classes_and_components(docs, key, text, shingle, num, den)


def _classes_and_components(docs: DataFrame, key: str, text: str, shingle: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    d = inner_names(docs, {key: "key", text: "text"}).withColumn("row", F.monotonically_increasing_id())
    inc = stage_table(_incidence(d, shingle, rarity_sketch(d, shingle), num, den), "incidence", keep=True)
    rows = inc.select("row", "key", "size", "d1", "d2")
    classes = stage_table(rows.where("size > 0").groupBy("d1", "d2", "size").agg(
        F.min("row").alias("rep"), F.min("key").alias("least_key"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = classes.select(F.col("rep").alias("row"))
    columns = inc.select("row", "size", "prefix").join(reps, "row", "left_semi").select("row", "size", F.posexplode("prefix").alias("at", "gram"))
    columns = columns.withColumn("head", F.col("at") <= F.col("size") - F.ceil(F.col("size") * (2 * num) / (num + den)))
    same = Window.partitionBy("gram")
    met_in = columns.select("*", F.min("row").over(same).alias("pivot"), F.max("row").over(same).alias("last"), F.max("head").over(same).alias("any_head"))
    groups = stage_table(met_in.where("last > pivot and any_head").select("gram", "row", "size", "at", "head", "pivot"), "groups")
    wanted = groups.select("row").distinct().join(inc.select("row", "size", "d1", "d2", "buckets"), "row")
    wanted = stage_table(wanted, "candidate-rows")
    met = groups.where("row <> pivot").groupBy("row", "pivot").agg(F.count(F.lit(1)).alias("n"))
    met = stage_table(_possible(met, wanted, num, den), "met")
    sets = _sets_of(met, wanted, d, shingle)
    first = met.groupBy("row").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("pivot"))
    comps = components(stage_table(_links(first, sets, num, den), "links").select("u", "v"))
    later = _apart(met.select("row", "pivot").join(first, ["row", "pivot"], "left_anti"), comps)
    comps = _with_links(comps, stage_table(later, "pairs"), sets, num, den)
    groups = groups.where("row <> pivot").select("gram", "row", "size", "at", "head")
    for peeled in (False, True):
        # what is left to compare: rows of a column, without its done pivots, in different components
        rest = groups.join(comps.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
        mixed = rest.groupBy("gram").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("n"),
                                         F.max("head").alias("any_head")).where("a < b and any_head").select("gram", "n")
        rest = stage_table(rest.join(mixed, "gram"), "groups")
        small = (F.col("n") <= DIRECT) | F.lit(peeled)
        few, many = rest.where(small), rest.where(~small)
        other = few.where("head").select("gram", *[F.col(c).alias(f"other_{c}") for c in ("row", "size", "at", "component")])
        behind = F.least(F.col("size") - F.col("at"), F.col("other_size") - F.col("other_at"))      # places are from 0
        pairs = (few.join(other, "gram").where("other_size <= size and component <> other_component")
                 .where(behind * (num + den) >= (F.col("size") + F.col("other_size")) * num)
                 .select(F.greatest("row", "other_row").alias("row"), F.least("row", "other_row").alias("pivot"), "size", "other_size"))
        least = many.groupBy("gram", "component").agg(F.min(F.struct("row", "size")).alias("least"))
        least = least.withColumn("place", F.row_number().over(Window.partitionBy("gram").orderBy("least.row"))).where(F.col("place") <= PEELS)
        least = least.select("gram", F.col("component").alias("pivot_component"), F.col("least.row").alias("pivot"), F.col("least.size").alias("other_size"))
        more = many.join(least, "gram").where("component <> pivot_component").select("row", "pivot", "size", "other_size")
        fits = F.least("size", "other_size") * den >= F.greatest("size", "other_size") * num
        pairs = pairs.union(more).where(fits).select("row", "pivot").distinct()
        pairs = stage_table(_possible(pairs, wanted, num, den), "pairs")
        if not pairs.isEmpty():
            sets = sets.union(_sets_of(pairs, wanted.join(sets, "row", "left_anti"), d, shingle))
            comps = _with_links(comps, pairs, sets, num, den)
        if many.isEmpty():
            break
        groups = many.join(least.select("gram", F.col("pivot").alias("row")), ["gram", "row"], "left_anti").select(*groups.columns)
    joined = classes.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return rows, stage_table(joined.withColumn("component", F.coalesce("component", "rep")), "class-components", keep=True)


def jaccard_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Per input row: key, n_shingles, component_id (least key reachable by links).

    Sets link when ``den * overlap >= num * union``. Null, empty and blank texts
    have empty sets and are linked with nothing, also not with one another;
    repeated rows are copies and come back as often; null keys are least only
    where a component has no other; texts are read whole; other columns are
    ignored.
    """
    rows, classes = classes_and_components(docs, key=key, text=text, shingle=shingle, num=num, den=den)
    least = classes.groupBy("component").agg(F.min("least_key").alias("component_id"))
    ids = classes.join(least, "component").select("d1", "d2", "size", "component_id")
    out = rows.join(ids, ["d1", "d2", "size"], "left")
    return out.select(F.col("key").alias(key), F.col("size").alias("n_shingles"),
                      F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group of near duplicates, that with the least key, with all its columns.

    Rows without words are in no group and stay. Of rows that agree in key and
    set, any one stays.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    with temporary_tables(docs.sparkSession):
        rows, classes = classes_and_components(docs, key=key, text=text, shingle=shingle, num=num, den=den)
        grouped = classes.groupBy("component").agg(F.min(F.struct(F.col("least_key").isNull(), "least_key", "rep")).alias("first"),
                                                   F.sum("copies").alias("members"))
        chosen = classes.join(grouped.where("members > 1"), "component").select(
            "d1", "d2", "size", (F.col("rep") == F.col("first.rep")).alias("stays"), "least_key")
        same = rows.join(chosen.where("stays"), ["d1", "d2", "size"]).where(F.col("key").eqNullSafe(F.col("least_key")))
        repeated = same.groupBy("d1", "d2", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("repeated", F.lit(True)).drop("n")
        decisions = stage_table(chosen.join(repeated, ["d1", "d2", "size"], "left"), "duplicate-decisions", keep=True)
    side = F.broadcast(decisions) if small_enough(decisions, BROADCAST_CLASSES) else decisions

    marked = _with_digests(inner_names(docs, names), names[text], shingle).join(side, ["d1", "d2", "size"], "left")
    kept = marked.where(F.col("stays").isNull() | (F.col("stays") & F.col(names[key]).eqNullSafe(F.col("least_key"))))
    out = kept.where("repeated is null")
    if not decisions.where("repeated").isEmpty():
        out = out.unionByName(kept.where("repeated").dropDuplicates(["d1", "d2", "size"]))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


DIGESTED = T.StructType([T.StructField(c, T.LongType()) for c in ("d1", "d2", "size")])


def _with_digests(rows: DataFrame, text: str, n: int) -> DataFrame:
    """All columns of ``rows`` and the digests and size of each set; only the texts go to Python."""
    def run(column: pa.Array) -> pa.Array:
        found = []
        for _, _, data, offsets in passes(column):
            w = Words(data, offsets, SPACE, lower=True)
            doc, h, sizes = row_sets(w, n)
            d1, d2 = digests(doc, h, w.n_docs)
            found.append((d1.view(np.int64), d2.view(np.int64), sizes.astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=DIGESTED.fieldNames())

    return rows.withColumn("digested", F.arrow_udf(run, DIGESTED)(F.col(text))).select(*rows.columns, "digested.*")
