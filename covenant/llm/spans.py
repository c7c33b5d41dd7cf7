"""Regex matches with positions, as column expressions (no Python in tasks).

Positions are code points from 0, the end exclusive. The text between matches
(``split``) and the matches (``regexp_extract_all``) alternate, so positions are
running sums of their lengths; sums are taken in blocks of about the square
root of the match count, so long texts stay far below quadratic cost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once for all uses in ``body``, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def matches(text: Column, pattern: str, context: int = 0) -> Column:
    """array<struct<start, end, value[, before, after]>> of the leftmost non-overlapping matches.

    ``pattern`` must not match the empty text. With ``context``, each match has
    up to that many code points of the text before and after it, as far as the
    neighbouring matches.
    """
    fields = [("start", F.lit(0)), ("end", F.lit(0)), ("value", F.lit(""))]
    if context:
        fields += [("before", F.lit("")), ("after", F.lit(""))]
    none = F.slice(F.array(F.struct(*[v.alias(n) for n, v in fields])), 1, 0)

    def with_gaps(found: Column, gaps: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))

        def place(i: Column, base: Column, first: Column, step: Column) -> Column:
            start = base + total(F.slice(step, first + 1, i - first)) + F.length(F.get(gaps, i))
            cols = [start.alias("start"), (start + F.length(F.get(found, i))).alias("end"), F.get(found, i).alias("value")]
            if context:
                cols += [F.right(F.get(gaps, i), F.lit(context)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(context)).alias("after")]
            return F.struct(*cols)

        def blocks(step: Column) -> Column:
            n = F.size(found)
            return let(F.ceil(F.sqrt(n)).cast("int"), lambda width: F.flatten(F.transform(
                F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")),
                lambda b: let(total(F.slice(step, 1, b * width)), lambda base: F.transform(
                    F.sequence(b * width, F.least(n, (b + 1) * width) - 1),
                    lambda i: place(i, base, b * width, step))))))

        return let(steps, blocks)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: with_gaps(found, gaps))).otherwise(none))


def kind_spans(found: Column, kind: int) -> Column:
    """Spans of one kind as array<struct<start, kind, end>>, kind a list position."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def joined(spans: Column, kinds: Sequence[str]) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def sha256_text(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)
