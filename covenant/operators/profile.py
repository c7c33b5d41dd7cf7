"""Result profiling (AGG-1..6): two scans, whatever the number of columns.

1. One aggregate over all columns: counts, bounds, sums, deviations, lengths and,
   for medians, a quantile sketch. Its single row also gives every numeric column
   a bracket of values around the middle rank, wider than the sketch's error.
2. One pass over (column, cell): values inside a bracket and distinct keys of
   string columns are grouped and counted; what lies below a bracket is one
   counter. Exact medians are ranked inside the bracket only (``selection``),
   distinct keys are counted.

Column names may hold any character.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.operators import selection

DISTINCT_HASH_OVER = 64   # longer strings are grouped by their sha-256 digest


def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.NumericType):
        return "numeric"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dt, T.StringType):
        return "string"
    return "other"


def columns_of(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind]


def quoted(name: str) -> str:
    """A column's name as an identifier, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def number(c: str) -> Column:
    """The cells as doubles: NaN counts as null, -0.0 is 0.0."""
    x = F.col(quoted(c)).cast("double")
    return F.when(~F.isnan(x), x + 0.0)


def _exact_sum(df: DataFrame, c: str) -> Column:
    """Order-independent sum: integers natively, fractions as decimals, so
    the total does not depend on how rows were split across tasks."""
    dt = df.schema[c].dataType
    if isinstance(dt, T.IntegralType):
        return F.sum(F.col(quoted(c)).cast("decimal(28,0)")).cast("double")
    x = number(c)
    exact = x.try_cast("decimal(28,10)")        # what does not fit is added as a double
    return (F.coalesce(F.sum(exact).cast("double"), F.when(F.count(x) > 0, F.lit(0.0)))
            + F.coalesce(F.sum(F.when(exact.isNull(), x)), F.lit(0.0)))


def _numeric_aggs(df: DataFrame, c: str, i: int) -> list[Column]:
    x = number(c)
    return [F.count(x).alias(f"n{i}"), F.count_if(x.isNull()).alias(f"z{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
            _exact_sum(df, c).alias(f"s{i}"), F.stddev_samp(x).alias(f"sd{i}"), selection.middle_bracket(x).alias(f"md{i}")]


def _datetime_aggs(c: str, i: int) -> list[Column]:
    x = F.col(quoted(c)).cast("timestamp_ntz")
    return [F.count(x).alias(f"n{i}"), F.count_if(x.isNull()).alias(f"z{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]


def _string_aggs(c: str, i: int) -> list[Column]:
    x = F.col(quoted(c))
    return [F.count(x).alias(f"n{i}"), F.count_if(x.isNull()).alias(f"z{i}"), F.coalesce(F.max(F.length(x)), F.lit(0)).cast("bigint").alias(f"ml{i}")]


def _boolean_aggs(c: str, i: int) -> list[Column]:
    x = F.col(quoted(c))
    return [F.count(x).alias(f"n{i}"), F.count_if(x.isNull()).alias(f"z{i}"), F.count_if(x).alias(f"t{i}"), F.count_if(~x).alias(f"f{i}")]


def _one_row(df: DataFrame, aggs: list[Column]) -> DataFrame:
    """The aggregate's single row, computed now, as a local frame."""
    wide = df.agg(*aggs)
    return df.sparkSession.createDataFrame([tuple(wide.first())], wide.schema)


def _mean(i: int) -> Column:
    return F.round(F.try_divide(F.col(f"s{i}"), F.col(f"n{i}")), 6)


def _rows(wide: DataFrame, structs: list[Column], schema: str) -> DataFrame:
    if not structs:
        return wide.sparkSession.createDataFrame([], schema)
    return wide.select(F.inline(F.array(*structs)))


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, exact_median: bool = True) -> DataFrame:
    """AGG-1: count, null_count, min, max, mean, median, sum, std per column that has a value.

    Without ``exact_median`` the median is the sketch's.
    """
    cols = list(columns) if columns is not None else columns_of(df, "numeric")
    schema = "column_name string, type string, count bigint, null_count bigint, min double, max double, mean double, median double, sum double, std double"
    wide = _one_row(df, [a for i, c in enumerate(cols) for a in _numeric_aggs(df, c, i)]) if cols else df.sparkSession.range(1)
    structs = [F.struct(F.lit(c).alias("column_name"), F.lit(dict(df.dtypes)[c]).alias("type"), F.col(f"n{i}").alias("count"),
                        F.col(f"z{i}").alias("null_count"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), _mean(i).alias("mean"),
                        F.round(F.get(f"md{i}", F.lit(1)), 6).alias("median"), F.round(F.col(f"s{i}"), 6).alias("sum"), F.round(F.col(f"sd{i}"), 6).alias("std"))
               for i, c in enumerate(cols)]
    out = _rows(wide, structs, schema).filter(F.col("count") > 0)
    brackets = _brackets(wide, cols) if exact_median and cols else {}
    if not brackets:
        return out
    found = selection.medians(selection.cells(df, {c: number(c) for c in cols}, brackets), brackets)
    # both sides have one row per column: a bounded join
    return (out.join(F.broadcast(found), "column_name", "left")
            .select(*[F.round("_median", 6).alias(c) if c == "median" else c for c in out.columns]))


def _brackets(wide: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float, int]]:
    """The middle brackets and counts of the columns that have a value."""
    row = wide.first()
    return {c: (row[f"md{i}"][0], row[f"md{i}"][2], row[f"n{i}"]) for i, c in enumerate(cols) if row[f"n{i}"]}


def datetime_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """AGG-2: count, null_count, min, max, range_days (floor of elapsed days)."""
    cols = list(columns) if columns is not None else columns_of(df, "datetime")
    wide = df.agg(*[a for i, c in enumerate(cols) for a in _datetime_aggs(c, i)]) if cols else df.limit(0)
    structs = [F.struct(
        F.lit(c).alias("column_name"), F.col(f"n{i}").alias("count"), F.col(f"z{i}").alias("null_count"),
        F.col(f"lo{i}").cast("string").alias("min"), F.col(f"hi{i}").cast("string").alias("max"),
        F.timestamp_diff("DAY", F.col(f"lo{i}"), F.col(f"hi{i}")).alias("range_days"))
        for i, c in enumerate(cols)]
    return _rows(wide, structs, "column_name string, count bigint, null_count bigint, min string, max string, range_days bigint").filter(F.col("count") > 0)


def distinct_key(c: Column) -> Column:
    """Grouping key for exact distinct counts: short values as they are,
    long texts by sha-256 so whole documents are not shuffled as keys."""
    s = c.cast("string")
    return F.when(F.length(s) > DISTINCT_HASH_OVER, F.concat(F.lit("#"), F.sha2(s, 256))).otherwise(
        F.concat(F.lit("="), s))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct non-null values per column: unpivot, de-duplicate
    (map-side partial aggregation absorbs hot values), count per column.
    Avoids the Expand that several count(DISTINCT) in one aggregate cause."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), distinct_key(F.col(quoted(c))).alias("k"))
                                for c in columns]))
    long = df.select(cells.alias("_c")).select("_c.column_name", "_c.k").filter(F.col("k").isNotNull())
    return long.distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_values"))


def string_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """AGG-3: count, null_count, unique_values, max_length (nulls ignored)."""
    cols = list(columns) if columns is not None else columns_of(df, "string")
    schema = "column_name string, count bigint, null_count bigint, unique_values bigint, max_length bigint"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    wide = df.agg(*[a for i, c in enumerate(cols) for a in _string_aggs(c, i)]).select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"n{i}").alias("count"), F.col(f"z{i}").alias("null_count"),
        F.col(f"ml{i}").alias("max_length")) for i, c in enumerate(cols)])))
    uniq = distinct_counts(df, cols)
    # both sides have one row per column: a bounded join
    return (wide.join(F.broadcast(uniq), "column_name", "left")
            .select("column_name", "count", "null_count",
                    F.coalesce("unique_values", F.lit(0)).cast("bigint").alias("unique_values"), "max_length"))


def boolean_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """AGG-4: value counts of boolean columns (nulls not counted)."""
    cols = list(columns) if columns is not None else columns_of(df, "boolean")
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, value boolean, count bigint")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(quoted(c)).alias("value"))
                                for c in cols]))
    return (df.select(cells.alias("_c")).select("_c.column_name", "_c.value")
            .filter(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")))


STATISTICS = "column_name string, kind string, stat string, value double, text string"


def column_statistics(df: DataFrame) -> DataFrame:
    """AGG-5: all statistics of all columns as one long table (column_name, kind, stat, value, text).

    ``value`` has numbers, ``text`` the datetimes' bounds and the columns'
    types. Numeric and datetime columns without a value only have their type,
    count and null_count. The row ('*', 'frame', 'total_columns') counts the columns.
    """
    fields = df.schema.fields
    kinds = [kind_of(f.dataType) for f in fields]
    make = {"numeric": lambda c, i: _numeric_aggs(df, c, i), "datetime": _datetime_aggs, "string": _string_aggs, "boolean": _boolean_aggs}
    other = lambda c, i: [F.count(F.col(quoted(c))).alias(f"n{i}"), F.count_if(F.col(quoted(c)).isNull()).alias(f"z{i}")]
    wide = _one_row(df, [F.count(F.lit(1)).alias("rows"), *[a for i, (f, k) in enumerate(zip(fields, kinds)) for a in make.get(k, other)(f.name, i)]])
    row = wide.first()

    def stat(i: int, name: str, value: Column | None = None, text: Column | None = None) -> Column:
        return F.struct(F.lit(fields[i].name).alias("column_name"), F.lit(kinds[i]).alias("kind"), F.lit(name).alias("stat"),
                        (value if value is not None else F.lit(None)).cast("double").alias("value"),
                        (text if text is not None else F.lit(None)).cast("string").alias("text"))

    structs = []
    for i, k in enumerate(kinds):
        col = lambda p, i=i: F.col(f"{p}{i}")
        structs += [stat(i, "type", text=F.lit(fields[i].dataType.simpleString())), stat(i, "count", col("n")), stat(i, "null_count", col("z"))]
        if k == "numeric" and row[f"n{i}"]:
            structs += [stat(i, "min", col("lo")), stat(i, "max", col("hi")), stat(i, "mean", _mean(i)), stat(i, "sum", F.round(col("s"), 6)),
                        stat(i, "std", F.round(col("sd"), 6))]
        elif k == "datetime" and row[f"n{i}"]:
            structs += [stat(i, "min", text=col("lo")), stat(i, "max", text=col("hi")),
                        stat(i, "range_days", F.timestamp_diff("DAY", col("lo"), col("hi")))]
        elif k == "string":
            structs.append(stat(i, "max_length", col("ml")))
        elif k == "boolean":
            structs += [stat(i, "true", col("t")), stat(i, "false", col("f"))]
    structs.append(F.struct(F.lit("*").alias("column_name"), F.lit("frame").alias("kind"), F.lit("total_columns").alias("stat"),
                            F.lit(float(len(fields))).alias("value"), F.lit(None).cast("string").alias("text")))
    out = wide.select(F.inline(F.array(*structs)))

    # the second scan: bracket values of numeric columns and distinct keys of strings, in one grouping
    brackets = {f.name: (row[f"md{i}"][0], row[f"md{i}"][2], row[f"n{i}"]) for i, (f, k) in enumerate(zip(fields, kinds))
                if k == "numeric" and row[f"n{i}"]}
    strings = [f.name for f, k in zip(fields, kinds) if k == "string"]
    if brackets or strings:
        grouped = selection.cells(df, {c: number(c) for c in brackets}, brackets, {c: distinct_key(F.col(quoted(c))) for c in strings})
        second = []
        if brackets:
            second.append(selection.medians(grouped, brackets).select("column_name", F.lit("numeric").alias("kind"), F.lit("median").alias("stat"),
                                                                      F.round("_median", 6).alias("value")))
        if strings:
            names = df.sparkSession.createDataFrame([(c,) for c in strings], "column_name string")
            n = grouped.where("k is not null").groupBy("column_name").agg(F.count(F.lit(1)).cast("double").alias("value"))
            second.append(F.broadcast(names).join(n, "column_name", "left").select("column_name", F.lit("string").alias("kind"), F.lit("unique_values").alias("stat"),
                                                                                   F.coalesce("value", F.lit(0.0)).alias("value")))
        for s in second:
            out = out.unionByName(s.withColumn("text", F.lit(None).cast("string")))
    return out
