import datetime as dt

import pytest
from pyspark.sql import types as T

from covenant.llm.queries import workers_find_package

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    workers_find_package(spark)

    def make(rows, extra=True):
        """Documents from (doc_id, text) pairs; with columns of clashing names."""
        df = spark.createDataFrame([(i, t, "en" if t is None or len(t) % 2 else "de", "src0", None if t is None else len(t))
                                    for i, t in rows], DOCS).repartition(3)
        if extra:
            from pyspark.sql import functions as F
            for c in ("k", "t", "row", "group", "offset", "hash", "n_words", "score", "kept", "key"):
                df = df.withColumn(c, F.lit(dt.date(2020, 1, 1)))
        return df
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty, blank, repeated and very long ones."""
    words = [f"w{i % 977}x{i % 13}" for i in range(30_000)]
    return [(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "  \n\t "), (None, "null id text"),
            (None, "null id text"), (5, "the quick brown fox jumps over the lazy dog"), (5, "the quick brown fox jumps over the lazy dog"),
            (6, " ".join(words)), (7, "x" * 4_000), (8, "é" * 300 + " naïve café\nœuvre"), (9, "  odd  spaces \r\n here")]
