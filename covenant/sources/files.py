"""File sources (SRC-1..8): data files by extension, contract texts,
response-cache records, file names as table names, schema profiles."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.operators import coercion as co
from covenant.operators.text import table_name

JSON_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"   # keep microseconds through JSON
FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".txt": "text"}

RESPONSE = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("thinking", T.StringType()),
    T.StructField("usage", T.StructType([T.StructField("input_tokens", T.LongType()),
                                         T.StructField("output_tokens", T.LongType())])),
    T.StructField("model", T.StringType()),
    T.StructField("cached", T.BooleanType()),
    T.StructField("timestamp", T.StringType()),
])


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy work enough tasks when the input arrives in fewer
    splits than the cluster has cores (e.g. one large single-row-group
    file). Large multi-file inputs already have more splits than cores, so
    this is a no-op there; filters and projections are still pushed through
    the repartition into the scan."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def spread_rows(df: DataFrame, rows_per_task: int) -> DataFrame:
    """Rows that cost much each, dealt so that a task gets at most about ``rows_per_task``, however large the input."""
    return spread(df, max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task)))


def format_of(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"unsupported data file format {ext!r}")
    return FORMATS[ext]


def _whole_json(spark: SparkSession, path: str) -> bool:
    """Whether JSON files hold one document each (an array or an object over several lines), not one a line.

    Looks at the beginnings of the first file: a line that opens an array, or
    one that opens an object and does not close it.
    """
    lines = [r[0].strip() for r in spark.read.text(path).where(F.trim("value") != "").select(F.substring("value", 1, 1_000_000)).limit(1).collect()]
    return bool(lines) and (lines[0].startswith("[") or (lines[0].startswith("{") and not lines[0].endswith("}")))


def read_data(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None,
              coerce: bool = True, multiline_json: bool | None = None) -> DataFrame:
    """SRC-1..4: read by extension (or ``fmt``). CSV is read as text with a
    header and then passed through the one-pass coercion gate instead of
    the reader's sampling inference; JSON files hold one record a line, or one
    document each (an array's elements are its records): ``multiline_json``
    says which, by default the beginning of the data does."""
    fmt = fmt or format_of(path)
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        df = r.option("header", True).option("inferSchema", False).csv(path)
        return co.coerce(df)[0] if coerce and schema is None else df
    if fmt == "json":
        if multiline_json is None:
            multiline_json = _whole_json(spark, path)
        return (r.option("multiLine", multiline_json).option("timestampNTZFormat", JSON_TS)
                .option("timestampFormat", JSON_TS).json(path))
    if fmt == "parquet":
        return r.parquet(path)
    if fmt == "text":
        return r.text(path, wholetext=True)
    raise ValueError(f"unsupported format {fmt!r}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: one row per text file: name, size, whole UTF-8 text."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_size").alias("file_size"),
                     F.col("value").alias("text_content"), "*").drop("value")


#: Ends a document in a bulk text file.
DOCUMENT_END = "\x1e\n"


def write_documents(docs: DataFrame, path: str, name: str = "filename", text: str = "text_content") -> None:
    """Many documents to few text files: per document its name on a line of its own, its text, and the end mark.

    A name must be one line; a text must not hold the end mark (such rows fail).
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = F.col(f"`{name}`").cast("string")
    bad = F.contains(t, F.lit(DOCUMENT_END)) | F.contains(named, F.lit("\n")) | F.contains(named, F.lit(DOCUMENT_END))
    row = F.when(bad, F.raise_error(F.lit("a document holds the end mark or its name a line break")).cast("string")).otherwise(F.concat(named, F.lit("\n"), t))
    docs.select(row.alias("value")).write.option("lineSep", DOCUMENT_END).text(path)


def read_bulk_documents(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5, bulk form: the documents of files written by ``write_documents``; large files are split between tasks."""
    raw = spark.read.option("lineSep", DOCUMENT_END).text(path)
    name = F.substring_index("value", "\n", 1)
    text = F.expr("substring(value, length(substring_index(value, '\\n', 1)) + 2)")
    return raw.select(name.alias("filename"), F.octet_length(text).cast("bigint").alias("file_size"), text.alias("text_content"))


#: Rows of a data file that its profile shows.
SAMPLE_ROWS = 90


def file_profile(spark: SparkSession, path: str, order: Sequence[str] = (), rows: int = SAMPLE_ROWS) -> DataFrame:
    """SRC-8: a data file in one row: name, size in bytes, its columns with their type labels, all rows, the first ``rows`` by ``order`` as JSON."""
    df = read_data(spark, path)
    files = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("file_size"))
    size = files.first()["file_size"]              # of the listing alone: no file is opened
    first = df.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in order]) if order else df
    sample = [r[0] for r in first.limit(rows).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()]
    labels = [co.type_label(f.dataType) or "string" for f in df.schema.fields]
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    array = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return total.select(F.lit(os.path.basename(path.rstrip("/"))).alias("file_name"), F.lit(size).cast("bigint").alias("file_size"),
                        array(df.columns).alias("headers"), array(labels).alias("column_types"), "total_rows",
                        F.lit(len(sample)).alias("row_count"), array(sample).alias("sample_data"))


def read_response_cache(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """SRC-6: cached response records.

    By default a small file holds one record, spread over lines or not, or one
    per line; the key is the file name without extension (or the ``cache_key=``
    folder). ``lines``: large files of one record a line that name their key."""
    if lines:
        keyed = T.StructType([T.StructField("cache_key", T.StringType()), *RESPONSE.fields])
        return spark.read.schema(keyed).json(path)
    whole = spark.read.text(path, wholetext=True)
    parts = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    one_per_line = F.forall(parts, lambda x: F.startswith(F.trim(x), F.lit("{")) & F.endswith(F.trim(x), F.lit("}")))
    key = F.col("cache_key") if "cache_key" in whole.columns else F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    records = whole.select(key.alias("cache_key"), F.explode(F.when(one_per_line, parts).otherwise(F.array("value"))).alias("_r"))
    return records.select("cache_key", F.from_json("_r", RESPONSE).alias("_r")).select("cache_key", "_r.*")


def with_table_names(df: DataFrame, file_col: str, out: str = "table_name") -> DataFrame:
    """SRC-7: route files to logical tables by their names."""
    return df.withColumn(out, table_name(F.col(file_col)))


def schema_profile(df: DataFrame, key: str, table: str) -> DataFrame:
    """SRC-8: one row per column — position, type label, the value of the
    row with the smallest ``key`` as sample, non-null and total counts —
    from a single aggregate."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f.name)
        aggs += [F.min_by(c.cast("string"), F.when(c.isNotNull(), F.col(key))).alias(f"s{i}"),
                 F.count(c).alias(f"n{i}")]
    structs = []
    for i, f in enumerate(df.schema.fields):
        lab = co.type_label(f.dataType)
        label = F.lit(lab) if lab is not None else F.coalesce(co.value_label(F.col(f"s{i}")), F.lit("string"))
        structs.append(F.struct(F.lit(table).alias("table_name"), F.lit(i + 1).alias("position"),
                                F.lit(f.name).alias("column_name"), label.alias("type_label"),
                                F.col(f"s{i}").alias("sample"), F.col(f"n{i}").alias("non_null"),
                                F.col("_rows").alias("total_rows")))
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def schema_text(profile: DataFrame) -> DataFrame:
    """TXT-3: the schema block of each table (≤ one line per column, so the
    per-table list is bounded by the schema width). FIXED VALUES: the wording
    "Table Name", "Total Columns" and the line form are what prompts expect."""
    line = F.concat(F.col("position").cast("string"), F.lit(". `"), F.col("column_name"), F.lit("` ("),
                    F.col("type_label"), F.lit(") = "), F.coalesce(F.col("sample"), F.lit("NULL")))
    g = profile.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("_l"),
        F.count(F.lit(1)).alias("n"))
    return g.select("table_name", F.concat(
        F.lit("Table Name: `"), F.col("table_name"), F.lit("`\nTotal Columns: "), F.col("n").cast("string"),
        F.lit("\n"), F.concat_ws("\n", F.transform("_l", lambda x: x["line"]))).alias("schema_text"))


def profile_tables(spark: SparkSession, tables: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    out = None
    for name, df, key in tables:
        p = schema_profile(df, key, name)
        out = p if out is None else out.unionByName(p)
    return out
