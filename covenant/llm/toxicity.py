"""Toxicity scores by non-negative positive-unlabelled learning.

Training knows confirmed toxic documents (positives) and a sample of all
documents, toxic or not (unlabelled). With the class prior p, the risk

    p * E_pos[l(z)] + max(0, E_unl[l(-z)] - p * E_pos[l(-z)])

estimates that of fully labelled data; where the second part falls below zero
it is a sign of overfitting, and the step goes the other way. l is the logistic
loss and z a linear score of hashed features: each document's distinct words
and word beginnings of 4 to 7 bytes, A-Z lower-cased. Only features whose shares
among the positives and all training documents differ (G test of at least
``SCREEN``) get a weight; document counts are taken over all training documents.

``CLASSIFIERS`` classifiers are trained, one task each, on a bounded sample: the
same ``POSITIVES`` confirmed documents and ``UNLABELLED`` documents of their
own, the first by a hash of the key. The score is the sigmoid of their mean,
shifted so that the mean score of all training documents is the prior, which is
estimated from all labelled training rows. Language, source and id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.llm.common import SPACE, Words, crc_remainder, inner_names, mix, passes, stage_table

FEATURE_BITS = 18
PREFIXES = (4, 5, 6, 7)
CLASSIFIERS = 3
#: Bounds of a classifier's sample of labelled and of unlabelled documents.
POSITIVES = 4000
UNLABELLED = 8000
SCREEN = 25.0
EPOCHS = 40
BATCHES = 20
RATE = 0.2
L2 = 1e-4


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of the distinct features, by document."""
    docs, hashes = [w.doc], [w.hash]
    for n in PREFIXES:
        long = np.flatnonzero(w.end - w.start > n)
        docs.append(w.doc[long])
        hashes.append(w.spans.hash(w.start[long], w.start[long] + n) + np.uint64(n))
    key = (np.concatenate(docs).astype(np.uint64) << np.uint64(FEATURE_BITS)) | (mix(np.concatenate(hashes)) >> np.uint64(64 - FEATURE_BITS))
    key = np.unique(key)
    return (key >> np.uint64(FEATURE_BITS)).astype(np.int64), (key & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int64)


def scores(doc: np.ndarray, feature: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Linear scores; ``weights`` ends with the bias."""
    return np.bincount(doc, weights=weights[feature], minlength=n) + weights[-1]


def screen(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Features held by ``a`` of ``n`` positives and ``b`` of ``m`` documents whose shares differ (G test)."""
    def fit(k: np.ndarray, of: int, share: np.ndarray) -> np.ndarray:
        own = np.clip(k / of, 1e-12, 1 - 1e-12)
        share = np.clip(share, 1e-12, 1 - 1e-12)
        return k * np.log(own / share) + (of - k) * np.log((1 - own) / (1 - share))
    return 2 * (fit(a, n, (a + b) / (n + m)) + fit(b, m, (a + b) / (n + m))) >= SCREEN


def feature_counts(lists: list[np.ndarray]) -> np.ndarray:
    return np.bincount(np.concatenate([np.zeros(0, np.int64), *lists]), minlength=1 << FEATURE_BITS)


def slopes(z: np.ndarray, is_pos: np.ndarray, prior: float) -> np.ndarray:
    """Derivative of the risk by each score; of minus the clean part where that is below zero."""
    toxic = 1 / (1 + np.exp(-np.clip(z, -30, 30)))       # slope of l(-z); that of l(z) is toxic - 1
    loss_as_clean = np.logaddexp(0, z)
    n, m = int(is_pos.sum()), int((~is_pos).sum())
    clean_part = np.where(is_pos, -prior * toxic / n, toxic / m)
    if loss_as_clean[~is_pos].mean() - prior * loss_as_clean[is_pos].mean() < 0:
        return -clean_part
    return clean_part + np.where(is_pos, prior * (toxic - 1) / n, 0.0)


def train(lists: list[np.ndarray], positive: np.ndarray, prior: float, seed: int, counts: np.ndarray | None = None, n_docs: int = 0) -> np.ndarray:
    """Weights (and bias) by AdaGrad on the non-negative PU risk.

    ``counts``: in how many of all ``n_docs`` training documents each feature is
    (by default those of the unlabelled documents here)."""
    rng = np.random.default_rng(seed)
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    weights = np.zeros((1 << FEATURE_BITS) + 1)
    weights[-1] = np.log(prior / (1 - prior))
    if not len(pos) or not len(unl):
        return weights
    if counts is None:
        counts, n_docs = feature_counts([lists[i] for i in unl]), len(unl)
    use = screen(feature_counts([lists[i] for i in pos]), len(pos), counts, n_docs)
    lists = [x[use[x]] for x in lists]
    history = np.full(len(weights), 1e-8)
    batches = max(1, min(BATCHES, len(pos) // 2, len(unl) // 2))
    for _ in range(EPOCHS):
        for p, u in zip(np.array_split(rng.permutation(pos), batches), np.array_split(rng.permutation(unl), batches)):
            members = [lists[i] for i in (*p, *u)]
            doc = np.repeat(np.arange(len(members)), [len(m) for m in members])
            flat = np.concatenate(members)
            z = scores(doc, flat, len(members), weights)
            is_pos = np.arange(len(members)) < len(p)
            slope = slopes(z, is_pos, prior)
            touched, at = np.unique(flat, return_inverse=True)
            g = np.bincount(at, weights=slope[doc]) + L2 * weights[touched]
            touched, g = np.append(touched, len(weights) - 1), np.append(g, slope.sum())
            history[touched] += g * g
            weights[touched] -= RATE * g / np.sqrt(history[touched])
    return weights


def _feature_blocks(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each feature is, and the documents; counters are added up block by block."""
    size = 1 << FEATURE_BITS
    blocks = 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in passes(batch.column("text")):
                w = Words(data, offsets, SPACE, lower=True)
                total += np.bincount(features(w)[1], minlength=size)
                n += w.n_docs
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.array(np.full(blocks, n)),
                                              pa.array([x.astype("<i8").tobytes() for x in np.split(total, blocks)], pa.binary())], names=["block", "docs", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<i8") for x in group.column("counts"))
        return pa.table({"block": group.column("block")[:1], "docs": pa.array([sum(group.column("docs").to_pylist())]), "counts": pa.array([total.tobytes()])})

    schema = "block int, docs long, counts binary"
    rows = docs.select("text").mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema).collect()      # 64 rows, 2 MB
    out = np.zeros((blocks, size // blocks), np.int64)
    for r in rows:
        out[r.block] = np.frombuffer(r.counts, "<i8")
    return out.ravel(), max((r.docs for r in rows), default=0)


def bias_shift(histogram: list[tuple[int, int]], prior: float) -> float:
    """What to add to scores, counted in hundredths, so that their mean probability is ``prior``."""
    if not histogram:
        return 0.0
    z, n = np.array([h[0] for h in histogram]) / 100 + 0.005, np.array([h[1] for h in histogram], dtype=np.float64)
    low, high = -60.0, 60.0
    for _ in range(60):
        shift = (low + high) / 2
        mean = (n / (1 + np.exp(-np.clip(z + shift, -500, 500)))).sum() / n.sum()
        low, high = (low, shift) if mean > prior else (shift, high)
    return shift


def _feature_lists(rows: DataFrame) -> DataFrame:
    """shards, positive, order and the features of the sampled documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column("text")):
                w = Words(data, offsets, SPACE, lower=True)
                doc, feature = features(w)
                ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=w.n_docs)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("shards", "positive", "order")), lists],
                                                 names=["shards", "positive", "order", "features"])

    return rows.select("shards", "positive", "order", "text").mapInArrow(run, "shards array<int>, positive boolean, order long, features array<int>")


def _sample(keys: DataFrame, size: int, positive: bool) -> DataFrame:
    """The first ``size`` keys by hash, each once: unlabelled ones dealt to the classifiers, positives for all."""
    order = F.xxhash64("key", F.lit(positive))
    picked = keys.where("key is not null").select("key").distinct().withColumn("order", order).orderBy("order", "key").limit(size)
    every = F.sequence(F.lit(0), F.lit(CLASSIFIERS - 1))
    shards = every if positive else F.array(F.pmod("order", F.lit(CLASSIFIERS)).cast("int"))
    return picked.select("key", F.lit(positive).alias("positive"), "order", shards.alias("shards"))


def fit(docs: DataFrame, labels: DataFrame, train_keys: Column, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float]:
    """Weights of the ``CLASSIFIERS`` classifiers, one row each, and the prior.

    ``docs``: key, text; ``labels``: key, toxic; ``train_keys``: condition on
    ``key`` for rows whose labels and texts may be learned from. A document
    with several labels is toxic if one says so.
    """
    known = labels.where(train_keys & F.col("toxic").isNotNull()).groupBy("key").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = stage_table(known, "toxic-labels")
    n, n_toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    prior = min(0.5, max(1e-3, (n_toxic or 0) / n)) if n else 1e-3
    sampled = _sample(known.where("toxic = 1"), positives, True).union(_sample(docs.where(train_keys), CLASSIFIERS * unlabelled, False))
    sampled = stage_table(sampled, "toxic-sample")
    rows = docs.join(F.broadcast(sampled), "key")       # at most positives + CLASSIFIERS * unlabelled keys
    lists = _feature_lists(rows).withColumn("shard", F.explode("shards"))
    counts, n_docs = _feature_blocks(docs.where(train_keys))
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("positive", "descending"), ("order", "ascending")])
        members = [np.asarray(v.values, dtype=np.int64) for v in shard.column("features").combine_chunks()]
        number = shard.column("shard")[0].as_py()
        weights = train(members, shard.column("positive").to_numpy(), prior, number, shared.value, n_docs)
        return pa.table({"shard": pa.array([number], pa.int32()), "weights": pa.array([weights.astype("<f4").tobytes()])})

    trained = lists.groupBy("shard").applyInArrow(run, "shard int, weights binary").collect()
    if not trained:
        return np.append(np.zeros(1 << FEATURE_BITS), np.log(prior / (1 - prior)))[None, :], prior
    return np.stack([np.frombuffer(r.weights, "<f4").astype(np.float64) for r in sorted(trained, key=lambda r: r.shard)]), prior


def toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label_key: str = "doc_id",
             label: str = "toxic", folds: int = 5, held_out: int = 0, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """Per input row: key, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Rows whose crc32 of the key's text modulo ``folds`` is ``held_out`` are
    never learned from. Null and empty texts get the score of a text without
    features; repeated rows come back as often; without labels the score is a
    constant; other columns are ignored.
    """
    d = inner_names(docs, {key: "key", text: "text"})
    training = crc_remainder(F.col("key"), folds) != held_out
    weights, prior = fit(d, inner_names(labels, {label_key: "key", label: "toxic"}), training, positives=positives, unlabelled=unlabelled)
    weights = weights.mean(axis=0).astype(np.float32)
    shared = d.sparkSession.sparkContext.broadcast(weights)      # 2^18 floats: 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column("text")):
                w = Words(data, offsets, SPACE, lower=True)
                z = scores(*features(w), w.n_docs, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, hi - lo), pa.array(z)], names=["key", "z"])

    scored = stage_table(d.mapInArrow(run, T.StructType([T.StructField("key", d.schema["key"].dataType), T.StructField("z", T.DoubleType())])), "toxic-scores")
    # bounded scores in hundredths: some thousand rows
    level = F.floor(F.least(F.greatest("z", F.lit(-60.0)), F.lit(60.0)) * 100).cast("int")
    shift = bias_shift([tuple(r) for r in scored.where(training).groupBy(level.alias("level")).count().collect()], prior)
    score = 1 / (1 + F.exp(-(F.col("z") + shift)))
    return scored.select(F.col("key").alias(key), (crc_remainder(F.col("key"), folds) == held_out).alias("held_out"), score.alias("score"),
                         (score >= 0.5).cast("int").alias("predicted"))
