"""Statements over given tables only, and the record of a run."""

import pytest

from covenant.operators import execution as ex
from covenant.sources import runs as rn


def record(spark, tmp_path, sql, run_id="r1", rows=250, **options):
    data = spark.range(rows).selectExpr("id", "id % 7 AS user_id", "CASE WHEN id % 2 = 0 THEN 'x' END AS note", "CAST(id AS DOUBLE) / 2 AS half")
    out = rn.run_record(spark, sql, data, "t", run_id=run_id, results=f"{tmp_path}/results", ledger=f"{tmp_path}/ledger", **options)
    return out


def test_record_of_a_run(spark, tmp_path):
    out = record(spark, tmp_path, "SELECT id, half, note FROM t WHERE id >= 50", order=["id"], sample_limit=3, source_file="t.csv", query_id="q")
    r = out.first()
    assert out.count() == 1 and (r.execution_status, r.rows_count, r.input_rows, r.input_columns, r.output_columns) == ("success", 200, 250, 4, 3)
    assert r.columns == ["id", "half", "note"] and r.column_types == ["bigint", "double", "string"] and r.null_counts == [0, 0, 100]
    assert r.sample_truncated and [s.split(",")[0] for s in r.sample_data] == ['{"id":50', '{"id":51', '{"id":52'] and r.sample_limit == 3
    stats = {(s.column_name, s.stat): s.value for s in r.statistics}
    assert stats["half", "median"] == 74.75 and stats["note", "unique_values"] == 1.0
    assert r.sanity_check_status == "passed" and ("note", "null_pct") in {(c.column_name, c.check) for c in r.sanity_checks}
    assert spark.read.parquet(f"{tmp_path}/results").count() == 200


def test_a_retry_replaces_and_other_runs_stay(spark, tmp_path):
    for run, sql in (("a", "SELECT id FROM t"), ("b", "SELECT id FROM t WHERE id < 5"), ("a", "SELECT id FROM t WHERE id < 9")):
        record(spark, tmp_path, sql, run)
    assert {r.run_id: r.rows_count for r in rn.read_records(spark, f"{tmp_path}/ledger").collect()} == {"a": 9, "b": 5}
    assert spark.read.parquet(f"{tmp_path}/results").count() == 14


def test_empty_and_failing_runs(spark, tmp_path):
    r = record(spark, tmp_path, "SELECT * FROM t WHERE id < 0", "none").first()
    assert (r.execution_status, r.rows_count, r.sanity_check_status, r.sample_truncated, r.sample_data) == ("success", 0, "warning", False, [])
    for i, sql in enumerate(["SELECT missing FROM t", "DROP TABLE t", "SELECT id / 0 FROM t", None]):
        r = record(spark, tmp_path, sql, f"bad{i}").first()
        assert r.execution_status == "error" and r.message and r.rows_count is None
    with pytest.raises(ValueError):
        record(spark, tmp_path, "SELECT 1", "../up")


def test_other_tables_and_views_are_out_of_reach(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("mine")
    spark.range(4).createOrReplaceTempView("other")
    spark.range(2).write.mode("overwrite").saveAsTable("stored_apart")
    files = spark.conf.get("spark.sql.runSQLOnFiles", None)
    try:
        given = {"mine": spark.range(7), "t": spark.range(1)}
        assert ex.run_sql(spark, "SELECT * FROM mine", given).count() == 7
        assert ex.run_sql(spark, "WITH x AS (SELECT * FROM mine) SELECT * FROM x ORDER BY id DESC", given, limit=2).collect()[0].id == 6
        assert spark.table("mine").count() == 3 and spark.conf.get("spark.sql.runSQLOnFiles", None) == files
        for sql in ("SELECT * FROM other", "SELECT * FROM stored_apart", "SELECT * FROM default.stored_apart", "SELECT * FROM t; SELECT 1"):
            with pytest.raises(Exception):
                ex.run_sql(spark, sql, given)
        assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("_given_")]
    finally:
        spark.catalog.dropTempView("mine")
        spark.catalog.dropTempView("other")
        spark.sql("DROP TABLE stored_apart")
