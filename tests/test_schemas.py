"""Declared schemas: conforming and integrity."""

import pytest

from covenant.sources import schemas as sc


def test_declared_tables():
    for name, t in sc.SYSTEM_TABLES.items():
        names = [c for c, _ in t.columns]
        assert names[0] == "id" and len(names) == len(set(names)), name
        assert set(t.unique) | set(t.references) | set(t.defaults) <= set(names) and set(t.references.values()) <= set(sc.SYSTEM_TABLES)


def test_conform(spark):
    df = spark.createDataFrame([("1", None, ["a", "b"], "x", "12.5"), ("no number", "failed", None, "y", None)],
                               "id string, execution_status string, result_data array<string>, extra string, execution_time_ms string")
    out = sc.conform(df, "calculations")
    assert [tuple(c) for c in out.dtypes] == [tuple(c) for c in sc.SYSTEM_TABLES["calculations"].columns]
    a, b = out.collect()
    assert (a.id, a.result_data, a.execution_time_ms, a.result_rows_count, a.table_name) == (1, '["a","b"]', 12.5, 0, None)
    assert b.id is None and b.execution_status == "failed"
    user = sc.conform(spark.createDataFrame([(1, None)], "id int, role string"), "users").first()
    assert user.role == "reviewer" and user.is_active is True


@pytest.mark.parametrize("empty", [False, True])
def test_integrity(spark, empty):
    users = sc.conform(spark.createDataFrame([(1, "a", "x"), (2, "a", None), (2, "b", None), (None, "c", "y")], "id int, username string, email string"), "users")
    approvals = sc.conform(spark.createDataFrame([(1, 7, 1), (2, 7, 9), (3, None, None), (4, 8, 9)], "id int, calculation_id int, approved_by int"), "approvals")
    if empty:
        users, approvals = users.limit(0), approvals.limit(0)
    got = {(r.table_name, r.column_name, r.check): r.rows for r in sc.integrity({"users": users, "approvals": approvals}).collect()}
    want = {("users", "id", "missing_key"): 1, ("users", "id", "surplus_key"): 1, ("users", "username", "surplus_value"): 1, ("users", "email", "surplus_value"): 0,
            ("approvals", "id", "missing_key"): 0, ("approvals", "id", "surplus_key"): 0, ("approvals", "calculation_id", "surplus_value"): 1,
            ("approvals", "approved_by", "orphan"): 2}
    assert got == ({k: 0 for k in want} if empty else want)


def test_integrity_bounds_a_tasks_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from covenant.sources import schemas as sc
    monkeypatch.setattr(sc, "ROWS_PER_TASK", 100)
    df = spark.range(0, 2000, 1, 1).union(spark.range(0, 10, 1, 1))
    sizes = [r[0] for r in sc.dealt(df).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 2010 and max(sizes) < 250
    users = df.select("id", F.concat(F.lit("u"), F.col("id")).alias("username"), F.lit(None).cast("string").alias("email"))
    got = {tuple(r)[1:3]: r["rows"] for r in sc.integrity({"users": sc.conform(users, "users")}).collect()}
    assert got == {("id", "missing_key"): 0, ("id", "surplus_key"): 10, ("username", "surplus_value"): 10, ("email", "surplus_value"): 0}
