"""Fill-in-middle transformation with cut offsets from a boundary set.

The line ends of a text (code-point offsets) are kept as a set of 32-bit
numbers in the manner of Roaring bitmaps: numbers with the same upper 16 bits
share a container, which holds the lower 16 bits as a sorted array, a bitmap or
runs, whichever is smallest. Cumulative cardinalities over the containers make
``select(k)``, the k-th boundary, a binary search for the container and a select
inside it. Both cut offsets of a document are two selects.

Only the cut offsets come from Python (one Arrow batch in, three numbers a row
out); draws, form and output are column expressions.

Lines are ``[^\\n]*\\n|[^\\n]+``. The draws of a row depend on its key alone: h1 to
h4 are the first four 32-bit numbers of sha256("<seed>:<key>"). Null texts count
as empty, a null key as the empty string; empty texts and texts that hold a
sentinel stay as they are (form ``plain``); repeated rows are transformed alike;
an empty table gives an empty result; other columns pass through unless they
bear the name of a result column, which replaces them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Members up to which a container is an array (two bytes each, as large as a bitmap).
ARRAY_MOST = 4096
BITMAP_BYTES = 8192


class ArrayContainer:
    def __init__(self, low: np.ndarray):
        self.low = low

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """65,536 bits; ``before[i]`` members lie in the words before word ``i``."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << 16, dtype=np.uint8)
        bits[low] = 1
        self.bytes = np.packbits(bits, bitorder="little")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.bytes.view("<u8")), dtype=np.int64)))

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        bits = np.unpackbits(self.bytes[8 * word:8 * word + 8], bitorder="little")
        return 64 * word + int(np.flatnonzero(bits)[k - self.before[word]])


class RunContainer:
    """Runs of consecutive members by first member; ``before[i]`` members lie in earlier runs."""

    def __init__(self, first: np.ndarray, length: np.ndarray):
        self.first = first
        self.before = np.concatenate(([0], np.cumsum(length)))

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.first[run]) + k - int(self.before[run])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of sorted 16-bit members (four bytes a run)."""
    starts = np.flatnonzero(np.diff(low, prepend=low[0] - 2) != 1)
    if 4 * len(starts) < min(2 * len(low), BITMAP_BYTES):
        return RunContainer(low[starts], np.diff(np.append(starts, len(low))))
    return ArrayContainer(low) if len(low) <= ARRAY_MOST else BitmapContainer(low)


class BoundarySet:
    """A set of 32-bit numbers, built from sorted distinct ``values``."""

    def __init__(self, values: np.ndarray):
        high = values >> 16
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        self.high = high[starts]
        self.cumulative = np.append(starts, len(values))
        self.containers = [container(values[a:b] & 0xFFFF) for a, b in zip(self.cumulative[:-1], self.cumulative[1:])]

    def __len__(self) -> int:
        return int(self.cumulative[-1])

    def select(self, k: int) -> int:
        """The member with ``k`` smaller ones."""
        at = int(np.searchsorted(self.cumulative, k, side="right")) - 1
        return (int(self.high[at]) << 16) + self.containers[at].select(k - int(self.cumulative[at]))


def line_ends(text: str) -> np.ndarray:
    """Code-point offsets after each line, ascending."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.flatnonzero(points == 0x0A) + 1
    return ends if not len(points) or points[-1] == 0x0A else np.append(ends, len(points))


CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "first", "second")])


def cut_offsets(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """Per text its line count and the offsets after h1 % (n+1) and h2 % (n+1) lines, the smaller first."""
    rows = []
    for t, *draws in zip(text, h1, h2):
        ends = BoundarySet(line_ends(t.as_py()))
        n = len(ends)
        units = sorted(d.as_py() % (n + 1) for d in draws)
        rows.append((n, *(ends.select(u - 1) if u else 0 for u in units)))
    columns = list(zip(*rows)) or [[], [], []]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=CUTS.fieldNames())


def draws(key: Column, seed: str) -> list[Column]:
    """h1 to h4 of a row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: str = "7",
                   fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output."""
    own = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [c for c in docs.columns if c not in own]
    h1, h2, h3, h4 = draws(F.col("row.`%s`" % key), seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("t", F.coalesce(F.col(f"row.`{text}`"), F.lit("")))
    rows = rows.withColumn("cut", F.arrow_udf(cut_offsets, CUTS)("t", h1, h2))
    marked = F.contains("t", F.lit(PREFIX)) | F.contains("t", F.lit(SUFFIX)) | F.contains("t", F.lit(MIDDLE))
    form = (F.when((F.col("t") == "") | marked | (h3 % 100 >= fim_percent), "plain")
            .when(h4 % 100 < spm_percent, "spm").otherwise("psm"))
    a, b = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix, middle = F.substring("t", F.lit(1), a), F.substring("t", a + 1, b - a)
    suffix = F.substring("t", b + 1, F.length("t"))
    rows = rows.withColumn("form", form)
    output = (F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
              .otherwise(F.col("t")))
    plain = F.col("form") == "plain"
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("cut.n").alias("n"), "form",
                       F.when(~plain, F.col("cut.first")).alias("prefix_chars"),
                       F.when(~plain, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of which ``output`` was made; texts that hold a sentinel were left plain, so every sentinel is ours."""
    parts = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), "<[PSM]>", -1)
    a, b, middle = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    return F.when(form == "psm", F.concat(a, middle, b)).when(form == "spm", F.concat(b, middle, a)).otherwise(output)


def fill_in_middle_report(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n, form, prefix_chars, middle_chars and the SHA-256 of the output and of the text rebuilt from it."""
    done = fill_in_middle(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")), key="k", text="t")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select(F.col("k").alias(key), "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
