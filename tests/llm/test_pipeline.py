import random

import corpus_pipeline
from covenant.llm.quality import quality_rules
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute as near
from tests.llm.test_packing import check, tok  # noqa: F401
from tests.llm.test_pii import BASE


def test_stages_against_brute_force(spark, make_docs, odd_rows, tmp_path, tok):  # noqa: F811
    rnd = random.Random(9)
    vocab = [f"word{i}" for i in range(900)]
    bench = [(i, " ".join(rnd.choices(vocab, k=15))) for i in range(5)]
    rows = odd_rows + [(100 + i, " ".join(rnd.choices(vocab, k=rnd.randint(5, 80)))) for i in range(150)]
    rows += [(500 + i, rows[-1 - i][1] + " tail") for i in range(40)] + [(600 + i, rows[20][1]) for i in range(20)]
    rows += [(700 + i, " ".join(rnd.choices(vocab, k=30)) + " " + bench[i % 5][1]) for i in range(10)]
    rows += [(800 + i, " ".join(rnd.choices(vocab, k=30)) + f" mail person{i}@example.com or call +1 555 010 {i:04d}") for i in range(10)]
    docs = make_docs(rows, extra=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(t is not None and len(t) > 60), 0) for i, t in rows if i is not None and i % 2], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules" and len(corpus_pipeline.STAGES) == 5
    passed = {r.doc_id for r in quality_rules(docs, labels).where("kept").collect()}
    left = [(i, t) for i, t in rows if i in passed]
    _, group = near(left, 5, 80, 100)
    first = {}
    for (i, t), g in zip(left, group):
        first.setdefault(g, []).append((i is None, i or 0, t))
    left = [(None if n else i, t) for n, i, t in (min(v, key=lambda x: x[:2]) for v in first.values())]
    left = [(i, t) for i, t in left if not contaminated(t, bench)[4]]

    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, current, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/out{n}")
        current = spark.read.parquet(f"{tmp_path}/out{n}")
    texts = [(r.doc_id, r.text) for r in current.collect()]
    assert sorted(i for i, _ in texts if i is not None) == sorted(i for i, _ in left if i is not None) and len(texts) == len(left)
    assert all(r.n_chars == len(r.text) for r in current.where("text is not null").collect())
    before = dict(left)
    assert all(t == before[i] or "[" in t for i, t in texts if i is not None)
    assert not any(rx.search(t) and ok(rx.search(t)[0]) for _, t in texts for rx, ok in BASE[:1])
    check(texts, corpus_pipeline.packing(spark, current, str(tmp_path)).collect(), tok, 2048)
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len({i for i, _ in left})


def write_tables(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_empty_tables(spark, make_docs, tmp_path):
    write_tables(spark, make_docs([], extra=False), tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_clashing_columns_nulls_and_repeats(spark, make_docs, tmp_path):
    """Columns named as the operators' own come through; null, empty and short texts go; of repeated rows one stays."""
    long = " ".join(f"word{i}" for i in range(30))
    docs = make_docs([(1, long), (1, long), (2, long.upper()), (None, long.replace("word", "other")), (3, None), (4, ""), (5, "too short")])
    write_tables(spark, docs, tmp_path)
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == docs.columns, name
    rows = current.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 1), (True, 0)] and all(str(r.score) == "2020-01-01" for r in rows)
    no_chars = corpus_pipeline.pii(spark, docs.drop("n_chars"), str(tmp_path))
    assert "n_chars" not in no_chars.columns and no_chars.count() == 7
