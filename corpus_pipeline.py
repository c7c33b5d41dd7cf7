"""A training corpus from ``documents`` in five stages.

1. quality rules: documents that fail the base rules or a certified cutoff go;
2. n-gram Jaccard join (five words, similarity 0.8): one document of each
   group of near duplicates stays;
3. benchmark decontamination: documents with a benchmark window go;
4. PII: personal data and the words that disclose it are masked in the texts;
5. best-fit packing: the pieces of all documents with their sequences.

Each stage works on all that its predecessor kept.

Null and empty texts fail the quality rules and go with stage 1, as do texts of
under ten words; a null id is an id like any other there and stays. Repeated rows
are near duplicates of each other: one stays. An empty table gives an empty table
of pieces. Other columns, whatever their names, pass through stages 1 to 4
unchanged, but for ``n_chars``, which stage 4 sets to the masked text's length
where the table has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.llm.common import stage_table, table
from covenant.llm.decontaminate import drop_contaminated
from covenant.llm.jaccard import keep_one_of_each
from covenant.llm.packing import best_fit_pack
from covenant.llm.pii import sanitise
from covenant.llm.quality import keep_quality
from covenant.llm.queries import tokenizer_path, workers_find_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_find_package(spark)
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_find_package(spark)
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_find_package(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_find_package(spark)
    clean = sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_find_package(spark)
    return best_fit_pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates),
                                   ("benchmark_decontamination", decontaminate), ("pii", pii), ("best_fit_packing", packing)]

#: Cutoffs, disclosure and packing are not expressible in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stage_table(docs, f"pipeline-{name}")
    return docs
