"""Log-bilinear language model with noise-contrastive training.

The context words' vectors, each scaled by its place's weights, add up to a
predicted vector q. Every word is a model word: the ``COMMON`` most frequent ones
have vectors of their own, all others share those of the bucket that their hash
gives. The number of buckets follows the number of different words in the
training documents (about ``BUCKETS`` times its square root), so the model grows
with the corpus and no token lies outside it. Model words are dealt into about the
square root of their number of classes:

    P(w | context) = softmax over classes (q U' + b) * softmax over the class's words (q R' + b)
                     * (count(w) + 1) / (tokens of the bucket + its different words + 1)

(the last factor for words of buckets only), so normalised probabilities take two
short batched matrix products a token; a bucket's words and one unseen word share
its probability by their counts.

Training is one pass over all training documents: every task starts from the
same vectors and trains on its own part of the corpus (noise-contrastive
estimation of both softmax layers, AdaGrad); the vectors are then averaged by
tokens. Word counts are taken over all training documents. For lookups, words
with counts from a threshold on (at most ``HEAD`` words, so a bounded size) are
broadcast; the rest of the tokens find their counts by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.llm.common import SPACE, Words, crc_remainder, inner_names, passes, stage_table

COMMON = 4096
BUCKETS = 0.5
WIDTH = 16
CONTEXT = 3
#: Words with their counts (16 bytes each) that are broadcast for lookups.
HEAD = 1_000_000
BATCH = 2048
CLASS_NOISE = 16
WORD_NOISE = 8
RATE = 0.1
#: Rows of one softmax product, so that its logits stay in the cache.
ROWS = 4096

#: The token after a text, which is model word 0.
END = np.uint64(0x0E0D0E0D0E0D0E0D)
STOP = 0


@dataclass
class Lexicon:
    """Sorted hashes and counts of the head; model word of each; totals.

    Model words: ``STOP``, the common words, then 1 << ``bits`` buckets.
    """
    hashes: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    unigram: np.ndarray          # training counts of the model words, by model word
    bits: int
    bucket_log: np.ndarray       # log10 of each bucket's tokens + different words + 1
    tokens: int
    distinct: int

    @property
    def first_bucket(self) -> int:
        return len(self.unigram) - (1 << self.bits)

    def bucket_word(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64) + self.first_bucket

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of each hash in the head."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h


@dataclass
class Model:
    """in_: context vectors; places: weights of the context places; u, r: class and word vectors, bias last."""
    in_: np.ndarray
    places: np.ndarray
    u: np.ndarray
    r: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.in_, self.places, self.u, self.r]


def class_size(n: int) -> int:
    """Model words of a class, of which there are about as many as a class has words."""
    return max(1, math.isqrt(n))


def class_count(n: int) -> int:
    return -(-n // class_size(n))


def initial(unigram: np.ndarray) -> Model:
    """Small fixed vectors; the biases are those of the unigram model."""
    n, size = len(unigram), class_size(len(unigram))
    rng = np.random.default_rng(17)
    p = (unigram + 1.0) / (unigram + 1.0).sum()
    classes = np.bincount(np.arange(n) // size, weights=p)
    vectors = lambda k: rng.normal(0, 0.1, (k, WIDTH))
    u = np.column_stack((vectors(len(classes)), np.log(np.maximum(classes, 1e-12))))
    r = np.column_stack((vectors(n), np.log(p / classes[np.arange(n) // size])))
    return Model(vectors(n).astype(np.float32), np.full((CONTEXT, WIDTH), 1.0, np.float32), u.astype(np.float32), r.astype(np.float32))


def stream(w: Words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts in order: (document, hash, head place or -1, model word)."""
    n = len(w.hash) + w.n_docs
    at = np.arange(len(w.hash)) + w.doc
    hashes, doc = np.full(n, END), np.repeat(np.arange(w.n_docs), w.per_doc + 1)
    hashes[at] = w.hash
    distinct, back = np.unique(hashes, return_inverse=True)
    place, found = lexicon.find(distinct)
    word = np.where(found, lexicon.words[place] if len(lexicon.words) else 0, lexicon.bucket_word(distinct))
    word[distinct == END] = STOP
    return doc, hashes, np.where(found, place, -1)[back], word[back]


def contexts(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Model words of the ``CONTEXT`` tokens before each token; ``STOP`` before a text's first."""
    out = np.full((CONTEXT, len(word)), STOP, dtype=np.int64)
    for k in range(CONTEXT):
        if len(word) > k + 1:
            same = doc[k + 1:] == doc[:-k - 1]
            out[k, k + 1:][same] = word[:-k - 1][same]
    return out


def predict(m: Model, ctx: np.ndarray) -> np.ndarray:
    q = np.zeros((ctx.shape[1], WIDTH), np.float32)
    for k in range(CONTEXT):
        q += m.in_[ctx[k]] * m.places[k]
    return q


def _log_softmax_at(q: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log softmax(q vectors' + bias)[at], in float32."""
    out = np.empty(len(at), np.float32)
    weights, bias = np.ascontiguousarray(vectors[:, :-1].T), vectors[:, -1]
    for a in range(0, len(at), ROWS):
        logits = q[a:a + ROWS] @ weights
        logits += bias
        logits -= logits.max(axis=1)[:, None]
        own = logits[np.arange(len(logits)), at[a:a + ROWS]]
        np.exp(logits, out=logits)
        out[a:a + ROWS] = own - np.log(logits.sum(axis=1))
    return out


def _class_ranges(sorted_words: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(class, first, end) of the runs of sorted words."""
    cls, first = np.unique(sorted_words // size, return_index=True)
    return list(zip(cls.tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_words)]))


def log_probabilities(m: Model, ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Normalised natural log-probability of every token."""
    size = class_size(len(m.r))
    order = np.argsort(word, kind="stable")
    words = word[order]
    q = predict(m, ctx[:, order])
    log = _log_softmax_at(q, m.u, words // size)
    for c, a, b in _class_ranges(words, size):
        log[a:b] += _log_softmax_at(q[a:b], m.r[c * size:(c + 1) * size], words[a:b] - c * size)
    out = np.empty(len(word))
    out[order] = log
    return out


def _sum_rows(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    distinct, first = np.unique(keys[order], return_index=True)
    return distinct, np.add.reduceat(values[order], first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """One task's pass of noise-contrastive training.

    Noise is drawn once a step for the classes and once for each class's words,
    and shared by the step's tokens, so noise scores are matrix products too.
    """

    def __init__(self, unigram: np.ndarray):
        self.m = initial(unigram)
        self.size = class_size(len(unigram))
        p = unigram + 1.0
        cls = np.arange(len(p)) // self.size
        mass = np.bincount(cls, weights=p)
        self.class_p = mass / p.sum()
        self.word_p = p / mass[cls]
        self.cumulative = np.cumsum(self.word_p)          # a class's words end at its number plus one
        self.class_offset = np.log(CLASS_NOISE * np.maximum(self.class_p, 1e-12)).astype(np.float32)
        self.word_offset = np.log(WORD_NOISE * self.word_p).astype(np.float32)
        self.history = [np.full(x.shape, 1e-7, np.float32) for x in self.m.parts()]
        self.rng = np.random.default_rng(5)

    def _move(self, part: int, rows: np.ndarray, g: np.ndarray) -> None:
        x, h = self.m.parts()[part], self.history[part]
        h[rows] += g * g
        x[rows] -= RATE * g / np.sqrt(h[rows])

    def step(self, ctx: np.ndarray, word: np.ndarray) -> None:
        m, n = self.m, len(word)
        order = np.argsort(word, kind="stable")
        ctx, word = ctx[:, order], word[order]
        cls = word // self.size
        x = np.ones((n, WIDTH + 1), np.float32)
        x[:, :-1] = predict(m, ctx)

        # classes
        noise = self.rng.choice(len(self.class_p), CLASS_NOISE, p=self.class_p)
        true = _sigmoid((x * m.u[cls]).sum(axis=1) - self.class_offset[cls]) - 1
        false = _sigmoid(x @ m.u[noise].T - self.class_offset[noise])
        dq = true[:, None] * m.u[cls] + false @ m.u[noise]
        du = np.zeros_like(m.u)
        rows, sums = _sum_rows(cls, true[:, None] * x)
        du[rows] = sums
        np.add.at(du, noise, false.T @ x)

        # words of each class
        ranges = _class_ranges(word, self.size)
        points = np.array([c for c, _, _ in ranges])[:, None] + self.rng.random((len(ranges), WORD_NOISE))
        drawn = np.minimum(np.searchsorted(self.cumulative, points), len(m.r) - 1)
        false = np.empty((n, WORD_NOISE), np.float32)
        for (_, a, b), k in zip(ranges, drawn):
            false[a:b] = x[a:b] @ m.r[k].T - self.word_offset[k]
        false = _sigmoid(false)
        true = _sigmoid((x * m.r[word]).sum(axis=1) - self.word_offset[word]) - 1
        dq += true[:, None] * m.r[word]
        noise_sums = np.empty((*drawn.shape, WIDTH + 1), np.float32)
        for i, ((_, a, b), k) in enumerate(zip(ranges, drawn)):
            dq[a:b] += false[a:b] @ m.r[k]
            noise_sums[i] = false[a:b].T @ x[a:b]
        rows, sums = _sum_rows(word, true[:, None] * x)
        r_rows, r_sums = _sum_rows(np.concatenate((rows, drawn.ravel())), np.concatenate((sums, noise_sums.reshape(-1, WIDTH + 1))))

        dq = dq[:, :-1]
        d_places = np.stack([(dq * m.in_[c]).sum(axis=0) for c in ctx])
        in_rows, in_sums = _sum_rows(ctx.ravel(), np.concatenate([dq * p for p in m.places]))
        self._move(0, in_rows, in_sums / n)
        self._move(1, np.arange(CONTEXT), d_places / n)
        self._move(2, np.arange(len(du)), du / n)
        self._move(3, r_rows, r_sums / n)


def _counts(docs: DataFrame) -> DataFrame:
    """h, n: token counts, the end token among them. Summed in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            h, back = np.unique(np.concatenate(hashes), return_inverse=True)
            return h, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)

        held_h, held_n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for _, _, data, offsets in passes(batch.column("text")):
                w = Words(data, offsets, SPACE, lower=True)
                h, n = np.unique(w.hash, return_counts=True)
                held_h += [h, np.array([END])]
                held_n += [n, np.array([w.n_docs])]
                if sum(map(len, held_h[1:])) > 1_000_000:
                    h, n = table(held_h, held_n)
                    held_h, held_n = [h], [n]
                    if len(h) > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])
                        held_h, held_n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        h, n = table(held_h, held_n)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def read_lexicon(counts: DataFrame, common: int = COMMON, head: int = HEAD) -> Lexicon:
    """The head's counts and the model words; reads at most ``head`` rows and one a bucket to the driver."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    levels = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("n")).cast("int")).count().collect()}
    least, total = 64, 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > head:
            break
        least = level
    end = int(END.view(np.int64))
    rows = counts.where((F.col("n") >= F.lit(2.0) ** least) | (F.col("h") == end)).toArrow()
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(h)
    h, n = h[order], n[order]
    frequent = np.lexsort((h, -n))
    frequent = frequent[h[frequent] != END][:common]

    bits = max(4, math.ceil(math.log2(BUCKETS * math.sqrt(distinct + 1))))
    buckets = counts.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).toArrow()
    held, different = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    held[buckets.column("b").to_numpy()] = buckets.column("n").to_numpy()
    different[buckets.column("b").to_numpy()] = buckets.column("words").to_numpy()
    own = np.concatenate((frequent, np.flatnonzero(h == END)))            # these have model words of their own
    np.subtract.at(held, (h[own] >> np.uint64(64 - bits)).astype(np.int64), n[own])
    np.subtract.at(different, (h[own] >> np.uint64(64 - bits)).astype(np.int64), 1)

    unigram = np.concatenate(([0], n[frequent], held)).astype(np.float64)
    unigram[STOP] = n[h == END].sum()
    lexicon = Lexicon(h, n, np.zeros(len(h), np.int64), unigram, bits, np.log10(held + different + 1.0), int(tokens), int(distinct))
    lexicon.words[:] = lexicon.bucket_word(h)
    lexicon.words[frequent] = np.arange(1, 1 + len(frequent))
    lexicon.words[h == END] = STOP
    return lexicon


def train_model(docs: DataFrame, lexicon: Lexicon) -> Model:
    """Averages the models that the tasks train on their parts of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon)
    shapes = [x.shape for x in initial(lexicon.unigram).parts()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, seen = Trainer(shared.value.unigram), 0
        for batch in batches:
            for _, _, data, offsets in passes(batch.column("text")):
                doc, _, _, word = stream(Words(data, offsets, SPACE, lower=True), shared.value)
                ctx = contexts(doc, word)
                for a in range(0, len(word), BATCH):
                    trainer.step(ctx[:, a:a + BATCH], word[a:a + BATCH])
                seen += len(word)
        if seen:
            flat = np.concatenate([x.ravel() for x in trainer.m.parts()]).astype(np.float64)
            flat = np.concatenate((flat, np.zeros(-len(flat) % WIDTH))).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(np.full(len(flat), seen, np.int64)),
                                              *(pa.array(flat[:, j]) for j in range(WIDTH))], names=["part", "n", *(f"x{j}" for j in range(WIDTH))])

    schema = "part int, n long, " + ", ".join(f"x{j} double" for j in range(WIDTH))
    means = docs.select("text").mapInArrow(run, schema).groupBy("part").agg(
        *[(F.sum(F.col(f"x{j}") * F.col("n")) / F.sum("n")).alias(f"x{j}") for j in range(WIDTH)]).toArrow()
    if not means.num_rows:
        return initial(lexicon.unigram)
    order = np.argsort(means.column("part").to_numpy())
    flat = np.stack([means.column(f"x{j}").to_numpy()[order] for j in range(WIDTH)], axis=1).ravel().astype(np.float32)
    out, at = [], 0
    for shape in shapes:
        out.append(flat[at:at + shape[0] * shape[1]].reshape(shape))
        at += shape[0] * shape[1]
    return Model(*out)


def _score(rows: DataFrame, lexicon: Lexicon, model: Model) -> DataFrame:
    """Per row what the head and the model give, and the tokens outside the head, whose counts are still to be added."""
    shared = rows.sparkSession.sparkContext.broadcast((lexicon, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = shared.value
        logs = np.log10(lexicon.counts + 1.0) if len(lexicon.counts) else np.zeros(1)
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column("text")):
                w = Words(data, offsets, SPACE, lower=True)
                doc, hashes, place, word = stream(w, lexicon)
                per = lambda x: np.bincount(doc, weights=x, minlength=w.n_docs)
                found = place >= 0
                log_count = np.where(found, logs[place], 0.0)
                bucket = word - lexicon.first_bucket
                outside = bucket >= 0
                share = np.where(outside, log_count - lexicon.bucket_log[np.maximum(bucket, 0)], 0.0)
                model_log = log_probabilities(model, contexts(doc, word), word) / np.log(10)
                away = np.flatnonzero(~found)
                order = np.lexsort((hashes[away], doc[away]))
                d, h = doc[away][order], hashes[away][order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                at = np.flatnonzero(first)
                times = np.diff(np.append(at, len(h)))
                ends = np.concatenate(([0], np.cumsum(np.bincount(d[at], minlength=w.n_docs)))).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                    [pa.array(h[at].view(np.int64)), pa.array(times.astype(np.int64))], names=["h", "times"]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in ("row", "key")), pa.array((w.per_doc + 1).astype(np.int64)),
                     pa.array(per(found & (lexicon.counts[place] > 0) if len(lexicon.counts) else found).astype(np.int64)), pa.array(per(log_count)),
                     pa.array(per(model_log + share)), rest],
                    names=["row", "key", "n_tokens", "known", "counts_log", "model_log", "rest"])

    schema = T.StructType([T.StructField("row", T.LongType()), rows.schema["key"], *T._parse_datatype_string(
        "n_tokens long, known long, counts_log double, model_log double, rest array<struct<h long, times long>>").fields])
    return rows.select("row", "key", "text").mapInArrow(run, schema)


def lm_scores(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folds: int = 7, held_out: int = 2,
              common: int = COMMON, head: int = HEAD) -> DataFrame:
    """Per input row: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the add-one unigram log10 probability, ``score`` that of
    the model; both include the end token. Null and empty texts have the end
    token only; a null key's crc32 is that of the empty text; repeated rows come
    back as often; without training documents every word is unknown; texts are
    read whole; other columns are ignored.
    """
    d = inner_names(docs, {key: "key", text: "text"})
    held = crc_remainder(F.col("key"), folds) == held_out
    train = d.where(~held)
    counts = stage_table(_counts(train), "lm-counts")
    lexicon = read_lexicon(counts, common, head)
    model = train_model(train, lexicon)
    scored = stage_table(_score(d.withColumn("row", F.monotonically_increasing_id()), lexicon, model), "lm-scored")

    away = scored.select("row", F.explode("rest").alias("t")).select("row", "t.*")
    found = (away.join(counts, "h").groupBy("row")
             .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_log")))
    out = scored.drop("rest").join(found, "row", "left").na.fill(0, ["more_known", "more_log"])
    tokens, distinct = lexicon.tokens, lexicon.distinct
    log_all = float(np.log10(tokens + distinct + 1.0))
    return out.select(
        F.col("key").alias(key), held.alias("held_out"), "n_tokens", (F.col("known") + F.col("more_known")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("counts_log") + F.col("more_log") - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("model_log") + F.col("more_log")).alias("score"))
