"""Small-frame checks of operators otherwise covered only by the oracle run."""

import json

from pyspark.sql import functions as F

from covenant.operators import costs as cs
from covenant.operators import execution as ex
from covenant.operators import ledger as lg
from covenant.operators import text as tx
from covenant.sources import files as fs
from covenant.sources import sinks as sk


def test_bounded_sample_flag_and_order(spark):
    df = spark.range(25).select(F.col("id"), (F.col("id") % 3).alias("g"))
    s = ex.bounded_sample(df, ["g", "id"], 10).collect()
    assert len(s) == 10 and all(r["truncated"] for r in s)
    assert [r["id"] for r in s][:3] == [0, 3, 6]
    s2 = ex.bounded_sample(df, ["id"], 25).collect()
    assert len(s2) == 25 and not any(r["truncated"] for r in s2)


def test_page_and_shape(spark):
    df = spark.range(100)
    assert [r["id"] for r in ex.page(df, ["id"], limit=5, offset=10).collect()] == [10, 11, 12, 13, 14]
    sh = ex.shape(df, df.filter("id < 7").select("id", F.lit(1).alias("x"))).first()
    assert tuple(sh) == (100, 1, 7, 2)


def test_run_sql_refuses_non_queries(spark):
    import pytest
    with pytest.raises(ValueError):
        ex.run_sql(spark, "DROP TABLE x", {})
    assert ex.run_sql(spark, "  -- note\nSELECT 1 AS one", {}).first()["one"] == 1


def test_cost_average_over_all_rows(spark):
    df = spark.createDataFrame([(10.0, "x"), (None, "3"), (20.0, "bad")], "fee_monetary double, tip_monetary string")
    r = {x["cost_type"]: x for x in cs.cost_by_type(df).collect()}
    assert r["monetary"]["total"] == 33.0           # 10 + 20 + 3, unparseable counts 0
    assert r["monetary"]["average"] == 11.0         # divided by all 3 rows
    assert r["monetary"]["columns"] == "fee_monetary,tip_monetary"


def test_dashboard_counters(spark):
    docs = spark.range(3)
    calcs = spark.createDataFrame([(1,), (2,)], "id long")
    appr = spark.createDataFrame(
        [(1, "approved", "2024-01-05 00:00:00"), (2, "pending", None), (3, "approved", "2023-01-01 00:00:00")],
        "calculation_id long, request_status string, approval_date string") \
        .withColumn("approval_date", F.col("approval_date").cast("timestamp_ntz"))
    costs = spark.createDataFrame([(1, -5.0), (1, -1.0), (3, -2.0)], "calculation_id long, delta_cost double") \
        .withColumn("delta_cost", F.col("delta_cost").cast("decimal(18,4)"))
    r = lg.dashboard(docs, calcs, appr, costs, "2024-01-07").first()
    assert (r["documents"], r["calculations"], r["pending_approvals"], r["completed_proofs"]) == (3, 2, 1, 2)
    assert (r["total_recovery"], r["recent_recovery"]) == (8.0, 6.0)


def test_split_cache(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, prompt_key string")
    c = spark.createDataFrame([("a",), ("a",), ("z",)], "prompt_key string")
    got = {r["id"]: r["status"] for r in tx.split_cache(p, c).collect()}
    assert got == {1: "hit", 2: "miss", 3: "hit"}


def test_schema_text(spark):
    df = spark.createDataFrame([(2, "b", 1.5), (1, None, 2.5)], "k long, s string, x double")
    prof = fs.schema_profile(df, "k", "t")
    txt = fs.schema_text(prof).first()["schema_text"]
    assert txt == "Table Name: `t`\nTotal Columns: 3\n1. `k` (integer) = 1\n2. `s` (string) = b\n3. `x` (float) = 2.5"


def test_json_rows_keep_nulls_and_micros(spark):
    df = spark.createDataFrame([(1, None, "2024-01-01 00:00:07.179575")], "a int, b string, t string") \
        .withColumn("t", F.col("t").cast("timestamp_ntz"))
    j = json.loads(sk.json_rows(df).first()["json"])
    assert j == {"a": 1, "b": None, "t": "2024-01-01T00:00:07.179575"}


def test_spread_is_noop_for_many_splits(spark):
    many = spark.range(0, 1000, numPartitions=64)
    assert fs.spread(many).rdd.getNumPartitions() == 64
    one = spark.range(0, 1000, numPartitions=1)
    assert fs.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
