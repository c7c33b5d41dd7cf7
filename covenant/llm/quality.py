"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document when a measure exceeds a cutoff. Cutoffs are
chosen per stratum from labelled documents so that, with confidence
``1 - delta`` over all strata and rules together, the rules falsely reject at
most ``max_false`` of a stratum's good documents:

* every rule gets an equal part of ``max_false`` (union bound over the rules);
* the hypothesis "this cutoff rejects more than that part" is tested by the
  exact binomial tail, which is the same as comparing the Clopper-Pearson
  upper bound with that part;
* within a rule, cutoffs are tested from the most lenient to stricter ones and
  the sequence stops at the first that is not certified, so no correction is
  needed inside a rule; across strata and rules ``delta`` is divided by their
  number (Bonferroni);
* of the certified cutoffs, that with the largest gain (bad documents rejected
  less ``GOOD_COST`` times good ones) is used; with no gain the rule stays off.

A stratum with too few labels certifies nothing, so its rules stay off.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.llm.common import SPACE, Words, inner_names, mix, passes, shingles, small_enough, stage_table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
RULES = ("symbols", "dup_lines", "repeats", "upper", "marks", "word_length")
#: Rows of thresholds (one per stratum) up to which they are broadcast.
BROADCAST_STRATA = 10_000
MAX_FALSE = 0.03
DELTA = 0.05
GOOD_COST = 3

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!?")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True


def _repeats(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its value occurs twice in its document, and whether it occurred before."""
    key = mix(value + mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, again = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    again[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, again


def measure_texts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The ``MEASURES`` of each text of one pass."""
    w = Words(data, offsets)
    n = w.n_docs
    at = np.searchsorted(offsets[1:], np.arange(len(data)), side="right")
    per = lambda flag: np.bincount(at[flag], minlength=n)
    visible = ~SPACE[data]

    begins = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(data == 0x0A) + 1)))
    begins = begins[begins < len(data)]
    ends = np.concatenate((begins[1:], [len(data)])) if len(begins) else begins
    closed = (ends > begins) & (data[ends - 1] == 0x0A) if len(begins) else np.zeros(0, bool)
    seen = np.concatenate(([0], np.cumsum(visible)))
    filled = seen[ends] > seen[begins]
    begins, ends = begins[filled], (ends - closed)[filled]
    line_doc = np.searchsorted(offsets[1:], begins, side="right")
    _, again = _repeats(line_doc, w.spans.hash(begins, ends))

    first = np.flatnonzero(w.doc[:-4] == w.doc[4:]) if len(w.doc) >= 5 else np.zeros(0, np.int64)
    twice, _ = _repeats(w.doc[first], shingles(w.hash, 5)[first] if len(first) else np.zeros(0, np.uint64))
    cover = np.zeros(len(w.doc) + 1, dtype=np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + 5, -1)
    repeated = np.cumsum(cover)[:len(w.doc)] > 0
    return [w.per_doc, per(visible & ((data & 0xC0) != 0x80)), per(_SYMBOL[data]), np.bincount(line_doc[again], minlength=n),
            np.bincount(w.doc[repeated], minlength=n), np.bincount(line_doc, minlength=n), per(_UPPER[data]), per(_MARK[data])]


MEASURED = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])


def measure_column(text: pa.Array) -> pa.Array:
    """The ``MEASURES`` of every text of a batch."""
    found = [measure_texts(data, offsets) for _, _, data, offsets in passes(text)]
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0)] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=list(MEASURES))


def _measured(rows: DataFrame, text: str) -> DataFrame:
    """All columns of ``rows`` and the measures of ``text``; only the texts go to Python, and only numbers come back."""
    found = rows.withColumn("measured", F.arrow_udf(measure_column, MEASURED)(F.col(text)))
    return found.select(*rows.columns, "measured.*")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def levels() -> dict[str, Column]:
    """Whole-number levels of the rules' measures; larger is worse."""
    share = lambda x, y, by=100: F.when(F.col(y) > 0, F.floor(by * F.col(x) / F.col(y))).otherwise(0).cast("int")
    return dict(zip(RULES, (share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"),
                            share("n_upper", "word_chars"), share("n_marks", "n_words"), share("word_chars", "n_words", 10))))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial(n, p)."""
    if k >= n:
        return 1.0
    i = np.arange(1, k + 1, dtype=np.float64)
    logs = np.concatenate(([0.0], np.cumsum(np.log((n - i + 1) / i) + math.log(p / (1 - p))))) + n * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson upper bound at confidence ``1 - delta``."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_tail(k, n, mid) > delta else (lo, mid)
    return hi


def select_cutoff(level: np.ndarray, good: np.ndarray, bad: np.ndarray, part: float, delta: float) -> tuple[int | None, float]:
    """Cutoff (reject above it) and its bound; None if no certified one gains."""
    order = np.argsort(level)
    level, good, bad = level[order], good[order], bad[order]
    n = int(good.sum())
    best, best_gain = None, 0
    for j in range(len(level) - 2, -1, -1):           # cutoff level[j]: rejects the levels above
        k = int(good[j + 1:].sum())
        if n == 0 or binomial_tail(k, n, part) > delta:
            break
        gain = int(bad[j + 1:].sum()) - GOOD_COST * k
        if gain > best_gain:
            best, best_gain = j, gain
    if best is None:
        return None, 1.0
    return int(level[best]), upper_bound(int(good[best + 1:].sum()), n, delta)


def thresholds(labelled: DataFrame, *, max_false: float = MAX_FALSE, delta: float = DELTA) -> DataFrame:
    """One row per stratum: cut_<rule> (null: the rule is off) and bound_<rule>.

    ``labelled``: stratum, good (0/1) and the rules' levels. Only counts per
    (stratum, rule, level) leave the aggregation.
    """
    stacked = labelled.select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("level")) for r in RULES])).alias("x"))
    counts = stage_table(stacked.groupBy("stratum", "x.rule", "x.level").agg(
        F.sum("good").cast("long").alias("good"), F.sum(1 - F.col("good")).cast("long").alias("bad")), "quality-counts")
    strata = counts.select("stratum").distinct().count()
    part, level_delta = max_false / len(RULES), delta / max(1, strata * len(RULES))

    schema = T.StructType([T.StructField("stratum", T.StringType()), *[f for r in RULES for f in (
        T.StructField(f"cut_{r}", T.IntegerType()), T.StructField(f"bound_{r}", T.DoubleType()))]])

    def run(group: pa.Table) -> pa.Table:
        rules = group.column("rule").to_numpy()
        row = [group.column("stratum")[0].as_py()]
        for rule in RULES:
            row += select_cutoff(*(group.column(c).to_numpy()[rules == rule] for c in ("level", "good", "bad")), part, level_delta)
        return pa.table([pa.array([v], t) for v, t in zip(row, [pa.string(), *[pa.int32(), pa.float64()] * len(RULES)])], names=schema.fieldNames())

    return stage_table(counts.groupBy("stratum").applyInArrow(run, schema), "quality-thresholds")


def _labelled(measured: DataFrame, labels: DataFrame, label_key: str, label: str) -> DataFrame:
    """Documents with a label; a document with several counts as good only if all say so."""
    own = (inner_names(labels, {label_key: "label_key", label: "label"}).where("label is not null")
           .groupBy("label_key").agg(F.min((F.col("label") == 1).cast("int")).alias("good")))
    return measured.where(~F.col("base_failed")).join(own, F.col("key") == F.col("label_key")).select("stratum", "good", *RULES)


def _judge(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    side = F.broadcast(cuts) if small_enough(cuts, BROADCAST_STRATA) else cuts
    judged = rows.join(side, "stratum", "left")
    reject = F.lit(False)
    for r in RULES:
        reject = reject | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~reject)


def quality_rules(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang",
                  label_key: str = "doc_id", label: str = "quality", max_false: float = MAX_FALSE, delta: float = DELTA) -> DataFrame:
    """Per input row: key, the measures, base_failed, kept.

    Null texts have no words and fail; a null stratum is one of its own;
    repeated rows come back as often; other columns are ignored.
    """
    rows = _measured(inner_names(docs, {key: "key", text: "text", stratum: "stratum"}), "text").drop("text")
    rows = rows.withColumn("stratum", F.coalesce(F.col("stratum").cast("string"), F.lit(""))).withColumn("base_failed", base_failed()).withColumns(levels())
    rows = stage_table(rows, "quality-measures")
    cuts = thresholds(_labelled(rows, labels, label_key, label), max_false=max_false, delta=delta)
    return _judge(rows, cuts).select(F.col("key").alias(key), *MEASURES, "base_failed", "kept")


def keep_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang",
                 label_key: str = "doc_id", label: str = "quality", max_false: float = MAX_FALSE, delta: float = DELTA) -> DataFrame:
    """The rows that ``quality_rules`` keeps, with all their columns.

    Texts are measured twice, once for the cutoffs and once to filter, instead
    of being shuffled.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = _measured(inner_names(docs, names), names[text])
    rows = (rows.withColumn("key", F.col(names[key])).withColumn("stratum", F.coalesce(F.col(names[stratum]).cast("string"), F.lit("")))
            .withColumn("base_failed", base_failed()).withColumns(levels()))
    slim = stage_table(rows.select("key", "stratum", "base_failed", *RULES), "quality-measures")
    cuts = thresholds(_labelled(slim, labels, label_key, label), max_false=max_false, delta=delta)
    return _judge(rows, cuts).where("kept").select(*[F.col(n).alias(c) for c, n in names.items()])
