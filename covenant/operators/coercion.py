"""Type detection and coercion of text columns (TYP-1..7).

Two phases: one aggregate pass decides every string column's type (the
decision table has one row per column and is the only thing collected),
then one projection applies the casts. Nothing is re-inferred by the reader:
read CSV as strings and let this gate decide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant import terms

VALID_RATIO = 0.8   # strict ">" gate, ratio over all rows including nulls


def _bool_words() -> Column:
    return F.array(*[F.lit(w) for w in terms.BOOLEAN_WORDS])


def is_bool_word(c: Column) -> Column:
    return F.array_contains(_bool_words(), F.lower(c))


def to_bool(c: Column) -> Column:
    """Lower-cased word map (accepts Yes/NO/T as well)."""
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(
        F.array_contains(F.array(*[F.lit(w) for w in terms.TRUE_WORDS]), F.lower(c)))


NUMBER_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(c: Column) -> Column:
    """Decimal text only (a cheap regex first: casting text that is not a
    number goes through the slow failure path of the cast)."""
    return F.when(c.rlike(NUMBER_SHAPE), c.try_cast("double"))


ISO_DATE_PREFIX = r"^\d{4}-\d{2}-\d{2}"


def to_datetime(c: Column) -> Column:
    """ISO dates / timestamps only (a bare number is not read as a year)."""
    return F.when(c.rlike(ISO_DATE_PREFIX), c.try_cast("timestamp_ntz"))


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def decide(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One aggregate pass → one row per column with the detected type.

    The boolean test needs "≤ 2 distinct raw values": only values that are
    boolean words enter the set, so its size is bounded by the word list's
    case variants no matter how large the table is.
    """
    cols = list(columns) if columns is not None else string_columns(df)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        x = F.col(c)
        aggs += [
            F.count(x).alias(f"nn{i}"),
            F.count_if(x.isNotNull() & ~is_bool_word(x)).alias(f"nb{i}"),
            F.size(F.collect_set(F.when(is_bool_word(x), x))).alias(f"bs{i}"),
            F.count(to_number(x)).alias(f"num{i}"),
            F.count(to_datetime(x)).alias(f"dt{i}"),
        ]
    wide = df.agg(*aggs)
    rows = F.col("_rows")
    stacked = []
    for i, c in enumerate(cols):
        nn, nb, bs, num, dt = (F.col(f"{p}{i}") for p in ("nn", "nb", "bs", "num", "dt"))
        dtype = (F.when(nn == 0, F.lit("string"))
                 .when((nb == 0) & (bs <= 2), F.lit("boolean"))
                 .when(num / rows > VALID_RATIO, F.lit("numeric"))
                 .when(dt / rows > VALID_RATIO, F.lit("datetime"))
                 .otherwise(F.lit("string")))
        stacked.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(i).alias("position"), dtype.alias("detected_type"),
            rows.alias("total_rows"), nn.alias("non_null"),
            F.round(F.try_divide(num, rows), 6).alias("numeric_ratio"),
            F.round(F.try_divide(dt, rows), 6).alias("datetime_ratio"),
            (nn - F.when(dtype == "numeric", num).when(dtype == "datetime", dt).otherwise(nn))
            .alias("lost_values"),
        ))
    return wide.select(F.inline(F.array(*stacked)))


def apply(df: DataFrame, decisions: dict[str, str]) -> DataFrame:
    """Cast columns according to ``{column: detected_type}``."""
    out = []
    for c in df.columns:
        t = decisions.get(c)
        x = F.col(c)
        if t == "boolean":
            out.append(to_bool(x).alias(c))
        elif t == "numeric":
            out.append(to_number(x).alias(c))
        elif t == "datetime":
            out.append(to_datetime(x).alias(c))
        else:
            out.append(x)
    return df.select(*out)


def coerce(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """TYP-4: decide, collect the per-column decision table, cast."""
    dec = {r["column_name"]: r["detected_type"] for r in decide(df, columns).collect()}
    return apply(df, dec), dec


# ---- TYP-5 / TYP-6 labels ----------------------------------------------------

def value_label(v: Column) -> Column:
    """Scalar label of a text value: boolean / integer / float / date / string."""
    low = F.lower(v)
    nulls = F.array(*[F.lit(w) for w in terms.NULL_WORDS])
    return (F.when(v.isNull() | F.array_contains(nulls, low), F.lit("string"))
            .when(low.isin("true", "false", "1", "0"), F.lit("boolean"))
            .when(to_number(v).isNotNull(),
                  F.when(v.contains("."), F.lit("float")).otherwise(F.lit("integer")))
            .when((v.contains("-") | v.contains("/")) & F.length(v).isin(10, 19), F.lit("date"))
            .otherwise(F.lit("string")))


def type_label(dt: T.DataType) -> str | None:
    """Label of a typed column; ``None`` means 'look at a sample value'."""
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dt, T.StringType):
        return None
    return dt.simpleString()


def column_labels(df: DataFrame, order_key: str) -> DataFrame:
    """TYP-6: one row per column with its label; text columns are labelled
    from their first non-null value in ``order_key`` order (min_by, a
    bounded aggregate, instead of a positional 'first row')."""
    aggs, structs = [], []
    for i, f in enumerate(df.schema.fields):
        lab = type_label(f.dataType)
        if lab is None:
            aggs.append(F.min_by(F.col(f.name), F.when(F.col(f.name).isNotNull(), F.col(order_key)))
                        .alias(f"s{i}"))
            label = F.coalesce(value_label(F.col(f"s{i}")), F.lit("string"))
        else:
            label = F.lit(lab)
        structs.append(F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                                label.alias("type_label")))
    base = df.agg(*aggs) if aggs else df.limit(1).select(F.lit(1).alias("_"))
    return base.select(F.inline(F.array(*structs)))
