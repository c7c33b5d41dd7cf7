"""Benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of an item (all of them in a shorter
item); a document word inside any occurrence of a window is hit.

1. The shingles (``SHINGLE`` words) of all windows are ordered by rarity: their
   occurrences are counted over all documents.
2. Containment of a whole window needs all its shingles, so its prefix is its
   rarest one; a window with a shingle that no document has is dropped.
3. Documents give up the places whose shingle is some window's prefix; the two
   sides join on the shingle. The prefix's place in the window fixes where the
   window would begin (positional bound), and it must fit into the document
   (length bound).
4. The words themselves are then compared over the window.

Tasks test shingles against a bitmap of ``BITS`` places that only saves work: a
place taken by chance, or a full bitmap for a huge benchmark, lets candidates
through that the join refuses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.llm.common import NOT_ALNUM, Words, bitmap, inner_names, passes, shingles, small_enough, stage_table, temporary_tables

WINDOW = 10
SHINGLE = 3
#: Places of the bitmap (2^22: 512 kB), the most that the driver gathers.
BITS = 22
#: Distinct windows up to this count are broadcast to the candidates; a window
#: is at most ``WINDOW`` words. Beyond it they are joined by a shuffle.
BROADCAST_WINDOWS = 50_000
#: Digests of contaminated texts (about 100 bytes each) up to which they are broadcast.
BROADCAST_TEXTS = 200_000

_MASK = np.uint64((1 << BITS) - 1)


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, NOT_ALNUM, lower=True)


def _in_document(w: Words, k: int) -> np.ndarray:
    """First words of the ``k``-word runs that lie within one document."""
    n = len(w.doc) - k + 1
    return np.flatnonzero(w.doc[:n] == w.doc[k - 1:]) if n > 0 else np.zeros(0, np.int64)


def _hits(hashes: np.ndarray, packed: np.ndarray) -> np.ndarray:
    place = hashes & _MASK
    return (packed[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & np.uint8(1) != 0


def item_windows(items: DataFrame, *, key: str, text: str, window: int) -> DataFrame:
    """item, words (of one window), shingles (their hashes), k (words of a shingle)."""
    source = inner_names(items, {key: "k", text: "t"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in passes(batch.column("t")):
                w = _words(data, offsets)
                rows, out, sh, ks = [], [], [], []
                for d in range(w.n_docs):
                    a, n = int(w.first[d]), int(w.per_doc[d])
                    size = min(window, n)
                    k = min(SHINGLE, size)
                    hashes = shingles(w.hash[a:a + n], k).view(np.int64) if n else []
                    words = w.text(a, a + n).split(" ") if n else []
                    for i in range(n - size + 1 if n else 0):
                        rows.append(lo + d)
                        out.append(words[i:i + size])
                        sh.append(hashes[i:i + size - k + 1])
                        ks.append(k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").take(pa.array(rows, pa.int32())), pa.array(out, pa.list_(pa.string())),
                     pa.array(sh, pa.list_(pa.int64())), pa.array(ks, pa.int32())], names=["item", "words", "shingles", "k"])

    schema = T.StructType([T.StructField("item", source.schema["k"].dataType),
                           *T._parse_datatype_string("words array<string>, shingles array<long>, k int").fields])
    return source.mapInArrow(run, schema)


def _shingle_counts(docs: DataFrame, ks: list[int], packed: np.ndarray) -> DataFrame:
    """Occurrences over all documents of the shingles that the bitmap lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in passes(batch.column("text")):
                w = _words(data, offsets)
                for k in ks:
                    h = shingles(w.hash, k)[_in_document(w, k)]
                    values, counts = np.unique(h[_hits(h, packed)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(values.view(np.int64)),
                                                      pa.array(counts.astype(np.int64))], names=["k", "shingle", "n"])
    return docs.select("text").mapInArrow(run, "k int, shingle long, n long").groupBy("k", "shingle").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, ks: list[int], packed: np.ndarray, window: int) -> DataFrame:
    """Per document: row, key, n_words and its places with a window's prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column("text")):
                w = _words(data, offsets)
                found: list[list[dict]] = [[] for _ in range(w.n_docs)]
                for k in ks:
                    start = _in_document(w, k)
                    h = shingles(w.hash, k)[start]
                    for j in np.flatnonzero(_hits(h, packed)).tolist():
                        i, d = int(start[j]), int(w.doc[start[j]])
                        a = max(int(w.first[d]), i - window + k)
                        b = min(int(w.first[d + 1]), i + window)
                        found[d].append({"k": k, "shingle": int(h[j].view(np.int64)), "place": i - int(w.first[d]),
                                         "before": i - a, "near": w.text(a, b)})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, hi - lo), batch.column("key").slice(lo, hi - lo), pa.array(w.per_doc.astype(np.int64)),
                     pa.array(found, place_type)], names=["row", "key", "n_words", "places"])

    place_type = pa.list_(pa.struct([("k", pa.int32()), ("shingle", pa.int64()), ("place", pa.int32()), ("before", pa.int32()), ("near", pa.string())]))
    key_type = docs.schema["key"].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", key_type), *T._parse_datatype_string(
        "n_words long, places array<struct<k int, shingle long, place int, before int, near string>>").fields])
    return docs.select("row", "key", "text").mapInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per input row: key, row (number), n_words, n_hit, items (sorted texts of the ids).

    Null and empty texts have no words; an item without words has no window; an
    item with a null id counts under the empty text; repeated rows come back as
    often; texts are read whole; other columns are ignored.
    """
    d = inner_names(docs, {key: "key", text: "text"}).withColumn("row", F.monotonically_increasing_id())
    wins = stage_table(item_windows(items, key=item_key, text=item_text, window=window), "windows")
    wins = wins.withColumn("id", F.sha2(F.array_join("words", " "), 256))
    ks = sorted(r[0] for r in wins.select("k").distinct().collect())
    each = wins.select("k", F.explode("shingles").alias("shingle")).distinct()
    counts = _shingle_counts(d, ks, bitmap(each, "shingle", BITS))

    # the rarest shingle of every distinct window, and its first place in the window
    places = (wins.dropDuplicates(["id"]).select("id", "k", "words", F.posexplode("shingles").alias("at", "shingle"))
              .join(counts, ["k", "shingle"], "left").withColumn("n", F.coalesce("n", F.lit(0))))
    prefix = (places.groupBy("id").agg(F.min(F.struct("n", "shingle", "at")).alias("rarest"), F.any_value("k").alias("k"), F.any_value("words").alias("words"))
              .where(F.col("rarest.n") > 0)
              .select("id", "k", "words", F.size("words").alias("length"), "rarest.shingle", "rarest.at"))
    prefix = stage_table(prefix, "window-prefixes")

    found = stage_table(_candidates(d, ks, bitmap(prefix, "shingle", BITS), window), "window-candidates")
    side = F.broadcast(prefix) if small_enough(prefix, BROADCAST_WINDOWS) else prefix
    c = found.select("row", "n_words", F.explode("places").alias("p")).select("row", "n_words", "p.*")
    start = F.col("place") - F.col("at")
    near = F.split("near", " ")
    met = (c.join(side, ["k", "shingle"])
           .where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
           .where(F.slice(near, F.col("before") - F.col("at") + 1, F.col("length")) == F.col("words"))
           .select("row", start.alias("start"), "length", "id").distinct())
    met = stage_table(met, "window-hits")
    words = (met.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("word")).distinct()
             .groupBy("row").agg(F.count(F.lit(1)).alias("n_hit")))
    ids = wins.select("id", F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item")).distinct()
    by_item = (met.select("row", "id").join(F.broadcast(ids) if small_enough(ids, BROADCAST_WINDOWS) else ids, "id").select("row", "item").distinct()
               .groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items")))
    return (found.select("row", "key", "n_words").join(words, "row", "left").join(by_item, "row", "left")
            .select(F.col("key").alias(key), F.col("row"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def contamination_report(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", **names) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated."""
    c = contamination(docs, items, key=key, **names)
    return c.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", **names) -> DataFrame:
    """The rows in which no window occurs, with all their columns."""
    columns = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = inner_names(docs, columns).withColumn("text_id", F.sha2(F.coalesce(F.col(columns[text]), F.lit("")).cast("binary"), 256))
    with temporary_tables(docs.sparkSession):
        hit = contamination(rows, items, key="text_id", text=columns[text], **names).where("n_hit > 0").select("text_id").distinct()
        hit = stage_table(hit, "contaminated-texts", keep=True)
    hit = F.broadcast(hit) if small_enough(hit, BROADCAST_TEXTS) else hit
    return rows.join(hit, "text_id", "left_anti").select(*[F.col(n).alias(c) for c, n in columns.items()])
