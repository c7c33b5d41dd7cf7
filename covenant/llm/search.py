"""Ranked lexical search by hashed max-sketches.

Index (one pass over the texts): a term's 64-bit hash gives it one of 65,536
coordinates; a document's sketch keeps, for each coordinate that occurs, the
largest count of a term there, rounded up to an 8-bit code. As the impact of a
term, ``w * (1000000000*tf div (1000*tf + 12*m))``, grows with tf, the impact of
the coordinate's maximum is an upper bound of that of each of its terms.

Lookup: the queries' coordinates are read from a batch of sketches into one
matrix, and weighted sums of its columns are upper bounds of all documents'
scores for all queries of a block.

1. The ``FIRST`` documents of highest bound of each query are scored exactly from
   their texts; the k-th best score found is the query's threshold.
2. All other documents whose bound could still beat that threshold (a higher bound,
   or the same and a smaller id) are scored as well; no others can be among the
   k best, so the result is exact. Batches are scored in descending order of the
   bound and raise the threshold of their task as they go.

Document frequencies are counted in the pass that builds the index, for the
queries' terms only. Queries are handled in blocks of ``BLOCK_TERMS`` terms; a
task holds one block and one batch of sketches, and blocks of up to ``INDEX_TERMS``
terms share an index. Where few pairs need scoring,
they are broadcast to the texts, else joined by a shuffle.

Null texts and queries have no terms; such queries and those without a term in
the corpus return no rows. Every row is a document of its own, also when ids
repeat; ids must be whole numbers; a null id comes after all others at equal scores. Repeated queries are
answered each on its own; null query ids are kept. Empty tables give an empty
result; other columns of the inputs are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.llm.common import NOT_ALNUM, Words, inner_names, passes, small_enough, stage_table

#: FIXED VALUES of the ranking: weights per mille, scale of an impact, saturation, share of the length.
WEIGHT_SCALE, IMPACT_SCALE, SATURATION, LENGTH_SHARE = 1000, 1_000_000_000, 12, 25
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}

COORDINATES = 1 << 16
#: Documents of highest bound scored first, per query asked for ``k``.
FIRST = 3
#: Distinct terms of one block of queries (a longer query is a block of its own).
BLOCK_TERMS = 20_000
#: Terms of the blocks that share one index (at least one block).
INDEX_TERMS = 500_000
#: Cells of one bound matrix.
MATRIX_CELLS = 1 << 21
BROADCAST_PAIRS = 200_000
#: Stands for a null id in comparisons and in the lists of pairs.
NO_ID = (1 << 63) - 1


def _code_table() -> np.ndarray:
    """The count that each 8-bit code stands for: exact up to 64, then in steps of about an eighth."""
    values = list(range(65))
    while len(values) < 255:
        values.append(values[-1] + max(1, values[-1] // 8))
    return np.array([*values, 1 << 62], dtype=np.int64)


CODES = _code_table()


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(ASCII_LOWER))


def term_hashes(terms: list[str]) -> np.ndarray:
    """The hashes that ``Words`` gives these terms."""
    data = np.frombuffer(" ".join(terms).encode(), dtype=np.uint8)
    return Words(data, np.array([0, len(data)]), NOT_ALNUM).hash


def weight(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(WEIGHT_SCALE * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Impact before the term's weight; counts beyond the exact range give the bound that none exceeds."""
    large = tf >= 1 << 33
    tf = np.where(large, 0, tf)
    return np.where(large, IMPACT_SCALE // WEIGHT_SCALE, IMPACT_SCALE * tf // (WEIGHT_SCALE * tf + SATURATION * m))


def length_norm(n_terms: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    return 100 - LENGTH_SHARE + LENGTH_SHARE * n_terms * n_docs // max(all_terms, 1)


def sketches(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, list[bytes], list[bytes], np.ndarray]:
    """Term counts, coordinates and codes of each text, and the document counts of the ``wanted`` hashes."""
    w = Words(data, offsets, NOT_ALNUM, lower=True)
    order = np.lexsort((w.hash, w.doc))
    doc, h = w.doc[order], w.hash[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))[:len(h)])
    tf = np.diff(np.append(new, len(h)))
    doc, h = doc[new], h[new]
    place = np.searchsorted(wanted, h)
    known = place < len(wanted)
    known[known] = wanted[place[known]] == h[known]
    df = np.bincount(place[known], minlength=len(wanted))
    at = (h >> np.uint64(48)).astype(np.uint16)               # sorted by hash, so sorted by coordinate
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])))[:len(at)])
    most = np.maximum.reduceat(tf, first) if len(first) else tf
    codes = np.searchsorted(CODES, most).astype(np.uint8)
    at, doc = at[first].astype("<u2"), doc[first]
    cut = np.searchsorted(doc, np.arange(w.n_docs + 1))
    return (w.per_doc, [at[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])],
            [codes[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], df)


INDEX = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("at", T.BinaryType()),
                      T.StructField("most", T.BinaryType()), T.StructField("term", T.LongType()), T.StructField("df", T.LongType())])


def build_index(docs: DataFrame, wanted: np.ndarray, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, n, at, most) of the documents and rows (term, df) of the ``wanted`` hashes, as a staged table."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(wanted)
    source = inner_names(docs, {key: "id", text: "t"}).withColumn("id", F.col("id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = INDEX.fieldNames(), shared.value
        df = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column("t")):
                n, at, most, found = sketches(data, offsets, known)
                df += found
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(n.astype(np.int64)),
                                                  pa.array(at, pa.binary()), pa.array(most, pa.binary()), none, none], names=names)
        got = np.flatnonzero(df)
        none, empty = pa.nulls(len(got), pa.int64()), pa.nulls(len(got), pa.binary())
        yield pa.RecordBatch.from_arrays([none, none, empty, empty, pa.array(known[got].view(np.int64)), pa.array(df[got])], names=names)

    return stage_table(source.mapInArrow(run, INDEX), "search-index")


class Block:
    """A block of queries in a task: terms, weights and the coordinates they use.

    ``counts`` has the terms of each query with their repeats, ``df`` the
    document counts of the corpus' terms.
    """

    def __init__(self, counts: list[Counter], df: dict[int, int], n_docs: int, all_terms: int):
        self.n_docs, self.all_terms = n_docs, all_terms
        vocabulary = sorted({t for c in counts for t in c})
        hashes = term_hashes(vocabulary)
        have = np.array([df.get(h, 0) for h in hashes.view(np.int64).tolist()], dtype=np.int64)
        self.term = {t: i for i, t in enumerate(vocabulary)}
        self.weight = weight(n_docs, have)
        coordinate = (hashes >> np.uint64(48)).astype(np.int64)
        self.used, column = np.unique(coordinate, return_inverse=True)
        self.column_of = np.full(COORDINATES, -1, dtype=np.int64)
        self.column_of[self.used] = np.arange(len(self.used))
        ids = [[self.term[t] for t in c if have[self.term[t]]] for c in counts]
        self.queries = [(np.array(i, dtype=np.int64), self.weight[i] * np.array([c[vocabulary[j]] for j in i], dtype=np.int64))
                        for i, c in zip(ids, counts)]
        # per query its columns, each once, with the sum of its terms' weights
        self.columns = []
        for i, w in self.queries:
            cols, back = np.unique(column[i], return_inverse=True)
            self.columns.append((cols, np.bincount(back, weights=w.astype(np.float64), minlength=len(cols))))
        self.flat = np.concatenate([c for c, _ in self.columns] or [np.zeros(0, np.int64)])
        self.flat_weight = np.concatenate([w for _, w in self.columns] or [np.zeros(0)])
        self.asked = np.array([q for q, (c, _) in enumerate(self.columns) if len(c)], dtype=np.int64)
        self.starts = np.cumsum([0, *[len(c) for c, _ in self.columns]])[self.asked]

    def rows_at_once(self) -> int:
        return max(1, MATRIX_CELLS // max(1, len(self.used), len(self.flat)))

    def bounds(self, n: np.ndarray, at: list[bytes], most: list[bytes]) -> np.ndarray:
        """Upper bounds of the scores: a row for each document, a column for each of ``asked``."""
        size = [len(m) for m in most]
        doc = np.repeat(np.arange(len(n)), size)
        column = self.column_of[np.frombuffer(b"".join(at), dtype="<u2")]
        hit = np.flatnonzero(column >= 0)
        doc, column = doc[hit], column[hit]
        top = CODES[np.frombuffer(b"".join(most), dtype=np.uint8)[hit]]
        matrix = np.zeros((len(n), len(self.used)))
        matrix[doc, column] = impact(top, length_norm(n, self.n_docs, self.all_terms)[doc])
        return np.add.reduceat(matrix[:, self.flat] * self.flat_weight, self.starts, axis=1)

    def score(self, terms: Counter, m: int, query: int) -> int:
        """The exact score of a text's terms for one query."""
        ids, w = self.queries[query]
        tf = np.array([terms.get(i, 0) for i in ids.tolist()], dtype=np.int64)
        return int((w * impact(tf, np.int64(m))).sum())


def _bound_rows(index: DataFrame, shared, pick) -> DataFrame:
    """Pairs (query, id, bound) that ``pick(bounds, ids, state)`` selects from each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, state = shared.value[0], {}
        names = ["query", "id", "bound"]

        def out(rows):
            q, i, b = rows
            return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(i.astype(np.int64)), pa.array(b.astype(np.float64))], names=names)

        if not len(block.asked):
            return
        for batch in batches:
            for lo in range(0, batch.num_rows, block.rows_at_once()):
                part = batch.slice(lo, block.rows_at_once())
                ids = part.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                bounds = block.bounds(part.column("n").to_numpy(zero_copy_only=False), part.column("at").to_pylist(), part.column("most").to_pylist())
                rows = pick(block, bounds, ids, state)
                if rows is not None:
                    yield out(rows)
        if "heaps" in state:
            rows = [(q, -i, b) for q, heap in state["heaps"].items() for b, i in heap]
            yield out([np.array(c) for c in zip(*rows)] if rows else [np.zeros(0)] * 3)

    return index.mapInArrow(run, "query int, id bigint, bound double")


def _highest(first: int):
    """Keeps the ``first`` documents of highest bound of each query over a whole task."""
    def pick(block: Block, bounds: np.ndarray, ids: np.ndarray, state: dict):
        heaps = state.setdefault("heaps", {int(q): [] for q in block.asked})
        for j, q in enumerate(block.asked.tolist()):
            heap, column = heaps[q], bounds[:, j]
            least = heap[0] if len(heap) == first else (0.0, 0)
            rows = np.flatnonzero(column >= max(least[0], 1e-9))
            if len(rows) > first:
                rows = rows[np.lexsort((ids[rows], -column[rows]))[:first]]
            for b, i in zip(column[rows].tolist(), (-ids[rows]).tolist()):
                (heapq.heappush if len(heap) < first else heapq.heappushpop)(heap, (b, i))
        return None
    return pick


def _above(shared):
    """All documents whose bound can beat a query's threshold (score, id)."""
    def pick(block: Block, bounds: np.ndarray, ids: np.ndarray, state: dict):
        if "limits" not in state:
            limits = shared.value[1]
            state["limits"] = (np.array([limits.get(int(q), (0, NO_ID))[0] for q in block.asked], dtype=np.float64),
                               np.array([limits.get(int(q), (0, NO_ID))[1] for q in block.asked], dtype=np.int64))
        score, last = state["limits"]
        row, j = np.nonzero((bounds > score) | ((bounds == score) & (bounds > 0) & (ids[:, None] < last)))
        return block.asked[j], ids[row], bounds[row, j]
    return pick


def _scored(docs: DataFrame, pairs: DataFrame, shared, k: int) -> DataFrame:
    """Exact scores (query, id, score) above 0 of all rows whose id stands in ``pairs`` (query, id, bound).

    A task scores a batch by descending bound and leaves out what its k best so far already beat.
    """
    asked = pairs.groupBy("id").agg(F.collect_list(F.struct("query", "bound")).alias("asked"))
    if small_enough(pairs, BROADCAST_PAIRS):
        asked = F.broadcast(asked)
    rows = docs.join(asked, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value[0]
        best: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            texts, ids, found = batch.column("t"), batch.column("id").to_pylist(), []
            todo = sorted(((p["bound"], r, p["query"]) for r, a in enumerate(batch.column("asked").to_pylist()) for p in a), reverse=True)
            counts: dict[int, tuple[Counter, int]] = {}
            for bound, r, q in todo:
                heap = best.setdefault(q, [])
                if len(heap) == k and (bound, -ids[r]) < heap[0]:
                    continue
                if r not in counts:
                    terms = terms_of(texts[r].as_py())
                    known = Counter(i for i in map(block.term.get, terms) if i is not None)
                    counts[r] = known, int(length_norm(np.int64(len(terms)), block.n_docs, block.all_terms))
                score = block.score(*counts[r], q)
                if score > 0:
                    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -ids[r]))
                    found.append((q, ids[r], score))
            q, i, s = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["query", "id", "score"])

    return rows.select("id", "t", "asked").mapInArrow(run, "query int, id bigint, score bigint")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """Blocks of (query id, its terms), read one after the other."""
    block, size = [], 0
    for row in queries.toLocalIterator():
        counts = Counter(terms_of(row["text"]))
        if not counts:
            continue
        if block and size + len(counts) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((row["item"], counts))
        size += len(counts)
    if block:
        yield block


def _groups(blocks: Iterator[list[tuple[object, Counter]]]) -> Iterator[list[list[tuple[object, Counter]]]]:
    """Runs of blocks that share an index."""
    group, size = [], 0
    for block in blocks:
        terms = sum(len(c) for _, c in block)
        if group and size + terms > INDEX_TERMS:
            yield group
            group, size = [], 0
        group.append(block)
        size += terms
    if group:
        yield group


def search(docs: DataFrame, queries: DataFrame, *, k: int = 20, key: str = "doc_id", text: str = "text",
           query_key: str = "item_id", query_text: str = "text") -> DataFrame:
    """The ``k`` documents of highest score above 0 of every query: query key, rank, key, score."""
    spark = docs.sparkSession
    source = inner_names(docs, {key: "id", text: "t"}).withColumn("id", F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)))
    items = inner_names(queries, {query_key: "item", query_text: "text"})
    item_type, id_type = items.schema["item"].dataType, docs.schema[key].dataType
    out = T.StructType([T.StructField(query_key, item_type), T.StructField("rank", T.IntegerType()),
                        T.StructField(key, id_type), T.StructField("score", T.LongType())])
    results = []
    for group in _groups(_blocks(items)):
        wanted = np.unique(np.concatenate([term_hashes(sorted({t for _, c in block for t in c})) for block in group]))
        index = build_index(docs, wanted, key=key, text=text)
        n_docs, all_terms = index.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r["term"]: r["df"] for r in index.where("df > 0").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        for block in group:
            ready = Block([c for _, c in block], df, n_docs, all_terms)
            best = _search_block(source, index, ready, k)
            names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)],
                                          T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item", item_type)]))
            results.append(best.join(F.broadcast(names), "query").select("item", "rank", "id", "score"))
    if not results:
        return spark.createDataFrame([], out)
    found = reduce(DataFrame.union, results)
    return found.select(F.col("item").alias(query_key), F.col("rank").cast("int").alias("rank"),
                        F.when(F.col("id") != NO_ID, F.col("id")).cast(id_type).alias(key), "score")


def _search_block(docs: DataFrame, index: DataFrame, block: Block, k: int) -> DataFrame:
    """(query, id, score, rank) of one block, as a staged table."""
    spark = docs.sparkSession
    kept = index.where("n > 0").select("id", "n", "at", "most")
    shared = spark.sparkContext.broadcast((block, {}))
    # 1. the documents of highest bound give each query its threshold
    order = Window.partitionBy("query").orderBy(F.desc("bound"), F.asc("id"))
    top = (_bound_rows(kept, shared, _highest(FIRST * k)).withColumn("r", F.row_number().over(order))
           .where(F.col("r") <= FIRST * k).groupBy("query", "id").agg(F.max("bound").alias("bound")))
    top = stage_table(top, "search-top")
    first = stage_table(_best(_scored(docs, top, shared, k), k), "search-first")
    limits = {r["query"]: (r["score"], r["id"]) for r in first.where(F.col("rank") == k).select("query", "score", "id").collect()}
    # 2. whatever can still beat it
    shared = spark.sparkContext.broadcast((block, limits))
    rest = _bound_rows(kept, shared, _above(shared)).groupBy("query", "id").agg(F.max("bound").alias("bound"))
    rest = stage_table(rest.join(top.select("query", "id"), ["query", "id"], "left_anti"), "search-rest")
    best = _best(first.select("query", "id", "score").union(_scored(docs, rest, shared, k)), k)
    return stage_table(best, "search-best")
