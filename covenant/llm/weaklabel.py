"""Quality classifier from weak labels.

``LABELLERS`` are overlapping heuristics that call a text good, bad or abstain.
Expectation-maximisation estimates each one's accuracies from how often their
votes agree, without any gold label: documents are reduced to their vote
patterns, at most 3^9 of them, whose counts over all documents are all that the
estimation needs. The posterior of a document's pattern is its soft label, and
soft labels train a linear scorer over hashed words, which also judges texts
that every labeller abstains on and sees what no heuristic looks at.

The scorer is fitted on a bounded sample: ``SAMPLE`` documents with at least one
vote, the first by a hash of the text within each side of the posterior, so both
sides are represented; everything else uses all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.llm.common import SPACE, Words, inner_names, mix, passes, stage_table
from covenant.llm.quality import measure_texts

#: Vote codes.
BAD, ABSTAIN, GOOD = 0, 1, 2
LABELLERS = ("length", "repeats", "lines", "symbols", "letters", "case", "marks", "endings", "variety")
EM_ROUNDS = 200
#: Votes from which a pattern takes part in the estimation.
ENOUGH = 4
FEATURE_BITS = 18
#: Documents of each side that the scorer is fitted on.
SAMPLE = 8000
EPOCHS = 6
RATE = 0.1


_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC0:] = True       # the first byte of a character outside ASCII


def votes(data: np.ndarray, offsets: np.ndarray, w: Words) -> np.ndarray:
    """One row of ``LABELLERS`` votes per text."""
    n_words, chars, symbols, dup_lines, repeats, lines, upper, marks = (np.asarray(m, dtype=np.float64) for m in measure_texts(data, offsets))
    words, chars, lines = np.maximum(n_words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    last = w.data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    ends = np.bincount(w.doc[np.isin(last, np.frombuffer(b".!?", np.uint8))], minlength=w.n_docs)
    distinct = np.bincount((np.unique((w.doc.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24))) >> np.uint64(40)).astype(np.int64),
                           minlength=w.n_docs)

    def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))

    at = np.searchsorted(offsets[1:], np.arange(len(data)), side="right")
    letters = np.bincount(at[_LETTER[data]], minlength=w.n_docs)
    some = n_words >= 20
    columns = [vote((n_words >= 50) & (chars / words < 9), (n_words < 3) | (chars / words > 15)),
               vote(some & (repeats == 0), repeats > 0.2 * words),
               vote((lines >= 3) & (dup_lines == 0), dup_lines > 0.3 * lines),
               vote(some & (symbols == 0), symbols > 0.1 * words),
               vote(some & (letters > 0.9 * chars), letters < 0.75 * chars),
               vote(some & (upper < 0.1 * chars), upper > 0.5 * chars),
               vote(some & (marks < 0.05 * words), marks > 0.3 * words),
               vote(some & (ends >= 0.02 * words) & (ends <= 0.4 * words), (n_words >= 40) & ((ends == 0) | (ends > 0.6 * words))),
               vote((n_words >= 30) & (distinct >= 0.3 * words), (n_words >= 30) & (distinct < 0.1 * words))]
    return np.stack(columns, axis=1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors of being good per pattern, chance of each vote: [class, labeller, vote]).

    Starts from "good unless a labeller says bad"; Laplace-smoothed. Fitted on
    patterns with at least ``ENOUGH`` votes, where votes overlap; there an
    abstention is a vote like any other. Patterns with fewer votes (short texts)
    are judged by the votes cast alone.
    """
    full = (patterns != ABSTAIN).sum(axis=1) >= min(ENOUGH, patterns.shape[1] // 2)
    hot = np.stack([patterns == v for v in range(3)], axis=2).astype(np.float64)
    post = np.where((patterns == BAD).any(axis=1), 0.1, 0.9)
    share = counts * full
    for _ in range(rounds):
        weight = np.stack([(1 - post) * share, post * share])
        chance = (np.einsum("cp,plv->clv", weight, hot) + 1) / (weight.sum(axis=1)[:, None, None] + 3)
        prior = (weight.sum(axis=1) + 1) / (share.sum() + 2)
        cast = chance / (1 - chance[:, :, ABSTAIN:ABSTAIN + 1])
        cast[:, :, ABSTAIN] = 1
        logs = np.log(prior)[:, None] + np.where(full, np.einsum("plv,clv->cp", hot, np.log(chance)), np.einsum("plv,clv->cp", hot, np.log(cast)))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post, chance


def word_features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of the distinct words and of their shapes, by document."""
    shape = np.where(w.end - w.start > 12, 12, w.end - w.start).astype(np.uint64)
    first, last = w.data[w.start].astype(np.uint64), w.data[w.end - 1].astype(np.uint64)
    shapes = mix((shape << np.uint64(16)) | (first << np.uint64(8)) | last)
    key = (np.concatenate((w.doc, w.doc)).astype(np.uint64) << np.uint64(FEATURE_BITS)) | (
        np.concatenate((mix(w.hash), mix(shapes + np.uint64(7)))) >> np.uint64(64 - FEATURE_BITS))
    key = np.unique(key)
    return (key >> np.uint64(FEATURE_BITS)).astype(np.int64), (key & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int64)


def linear(doc: np.ndarray, feature: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Scores of documents whose features have length 1 together; bias last."""
    length = np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))
    return np.bincount(doc, weights=weights[feature], minlength=n) / length + weights[-1]


def train_linear(lists: list[np.ndarray], target: np.ndarray, seed: int = 0) -> np.ndarray:
    """Logistic regression on soft labels by AdaGrad."""
    rng = np.random.default_rng(seed)
    weights = np.zeros((1 << FEATURE_BITS) + 1)
    history = np.full(len(weights), 1e-8)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(lists)), max(1, len(lists) // 200)):
            members = [lists[i] for i in part]
            doc, flat = np.repeat(np.arange(len(part)), [len(m) for m in members]), np.concatenate(members)
            slope = (1 / (1 + np.exp(-np.clip(linear(doc, flat, len(part), weights), -30, 30))) - target[part]) / len(part)
            length = np.sqrt(np.maximum(np.bincount(doc, minlength=len(part)), 1))
            touched, at = np.unique(flat, return_inverse=True)
            g = np.append(np.bincount(at, weights=(slope / length)[doc]), slope.sum())
            touched = np.append(touched, len(weights) - 1)
            history[touched] += g * g
            weights[touched] -= RATE * g / np.sqrt(history[touched])
    return weights


def _voted(docs: DataFrame) -> DataFrame:
    """key, order (a hash of the text), pattern (the votes in base 3) and the vote columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column("text")):
                v = votes(data, offsets, Words(data, offsets))
                pattern = (v * 3 ** np.arange(v.shape[1])).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("key", "order")), pa.array(pattern.astype(np.int32))],
                                                 names=["key", "order", "pattern"])

    schema = T.StructType([docs.schema["key"], T.StructField("order", T.LongType()), T.StructField("pattern", T.IntegerType())])
    return docs.select("key", "order", "text").mapInArrow(run, schema)


def _unpack(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3


def _fit(docs: DataFrame, voted: DataFrame, seen: list[int], posterior: np.ndarray, sample: int) -> np.ndarray:
    """Weights from the sampled documents' soft labels, in one task of at most 2 * ``sample`` documents."""
    silent = sum(ABSTAIN * 3 ** i for i in range(len(LABELLERS)))
    known = [(int(n), float(posterior[n])) for n in seen if n != silent]
    targets = voted.sparkSession.createDataFrame(known, "pattern int, target double")       # at most 3^9 rows
    soft = voted.groupBy("order").agg(F.any_value("pattern").alias("pattern")).join(F.broadcast(targets), "pattern")
    sides = [soft.where(side).orderBy(F.xxhash64("order"), "order").limit(sample) for side in (F.col("target") >= 0.5, F.col("target") < 0.5)]
    picked = stage_table(sides[0].union(sides[1]).select("order", "target"), "weak-sample")
    rows = docs.join(F.broadcast(picked), "order").select("order", "target", "text")      # bounded by the sample and its copies

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column("text")):
                w = Words(data, offsets, SPACE, lower=False)
                doc, feature = word_features(w)
                ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=w.n_docs)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("order", "target")),
                                                  pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))],
                                                 names=["order", "target", "features"])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("order")
        lists = [np.asarray(v.values, dtype=np.int64) for v in group.column("features").combine_chunks()]
        weights = train_linear(lists, group.column("target").to_numpy())
        return pa.table({"weights": pa.array([weights.astype("<f4").tobytes()])})

    lists = rows.mapInArrow(features, "order long, target double, features array<int>")
    once = lists.groupBy("order").agg(F.any_value("target").alias("target"), F.any_value("features").alias("features"))     # copies of a text once
    got = once.groupBy(F.lit(0).alias("all")).applyInArrow(run, "weights binary").collect()
    return np.frombuffer(got[0].weights, "<f4") if got else np.zeros((1 << FEATURE_BITS) + 1, np.float32)


def quality_classifier(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Per input row: key, vote_<labeller> (1 good, -1 bad, 0 abstain), posterior, score, predicted.

    ``posterior``: chance of being good given the votes; ``score``: that of the
    linear scorer, 0 to 1; ``predicted``: 1 where their mean log odds are at
    least 0. Null texts are empty, a text without words is voted short and
    scored by its lack of features; repeated rows come back as often; texts are
    read whole; other columns are ignored; no gold labels are used.
    """
    d = inner_names(docs, {key: "key", text: "text"}).withColumn("order", F.xxhash64(F.coalesce("text", F.lit(""))))
    voted = stage_table(_voted(d), "weak-votes")
    counted = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()      # at most 3^9 rows
    posterior = np.full(3 ** len(LABELLERS), 0.5)
    seen = [r.pattern for r in counted]
    if seen:
        posterior[seen], _ = estimate(_unpack(np.array(seen)), np.array([r.n for r in counted], dtype=np.float64))
    shared = d.sparkSession.sparkContext.broadcast(_fit(d, voted, seen, posterior, sample))     # 2^18 floats: 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column("text")):
                w = Words(data, offsets)
                v = votes(data, offsets, w)
                z = linear(*word_features(w), w.n_docs, shared.value)
                post = posterior[(v * 3 ** np.arange(v.shape[1])).sum(axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(lo, hi - lo), *(pa.array((c - 1).astype(np.int32)) for c in v.T), pa.array(post), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))],
                    names=["key", *(f"vote_{n}" for n in LABELLERS), "posterior", "score"])

    schema = T.StructType([d.schema["key"], *[T.StructField(f"vote_{n}", T.IntegerType()) for n in LABELLERS],
                           T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType())])
    odds = lambda c: F.log((F.col(c) + 1e-9) / (1 - F.col(c) + 1e-9))
    out = d.select("key", "text").mapInArrow(run, schema)
    return out.withColumn("predicted", (odds("posterior") + odds("score") >= 0).cast("int")).withColumnRenamed("key", key)
