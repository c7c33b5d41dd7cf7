"""Rows that the test tables do not hold: nulls, NaN, infinities, open intervals, long ladders."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from covenant.operators import costs as cs
from covenant.operators import execution as ex
from covenant.operators import intervals as iv
from covenant.operators import ledger as lg
from covenant.operators import profile as pf
from covenant.operators import quality as dq
from covenant.operators import rules as ru
from covenant.operators import windows as wn
from covenant.sources import files as fs

RULE = "contract_id int, rule_id string, metric string, threshold double, threshold_operator string, penalty_percentage double, penalty_amount double"


def test_odd_rules_and_values(spark):
    rules = spark.createDataFrame([(1, "a", "m", 1.0, ">", 5.0, None), (1, "b", "m", 0.0, "<", 4.0, None), (1, "c", "m", 0.5, "!=", None, None),
                                   (1, "d", "m", 0.5, "~", 99.0, None), (1, "e", "m", None, ">", 98.0, None)], RULE)
    values = [5.0, 5.0, float("inf"), float("-inf"), float("nan"), None, 0.5, 0.7]
    meas = spark.createDataFrame([(1, "m", v) for v in values], "contract_id int, metric string, value double")
    got = sorted((r.value, r.rule_id) for r in ru.evaluate(meas, rules, ["contract_id"]).collect())
    assert got == [(float("-inf"), "b"), (0.7, "c"), (5.0, "a"), (5.0, "a"), (float("inf"), "a")]


def test_forty_rules_on_one_metric(spark):
    rules = spark.createDataFrame([(1, f"r{i:02d}", "m", float(i), ">", float(i), None) for i in range(40)], RULE)
    meas = spark.createDataFrame([(1, "m", v) for v in (0.5, 10.5, 99.0)], "contract_id int, metric string, value double")
    assert sorted(r.rule_id for r in ru.evaluate(meas, rules, ["contract_id"]).collect()) == ["r00", "r10", "r39"]


def test_large_amounts_are_kept(spark):
    df = spark.createDataFrame([(2e14,), (5.0,)], "late_fee double")
    assert cs.cost_by_type(df).first().total == 2e14 + 5


def test_cost_column_names():
    assert cs.detect_cost_columns(["a_credits", "discount", "Total_Fee", "x_hours", "duration"]) == {
        "monetary": ["Total_Fee"], "credits": ["a_credits"], "hours": ["x_hours"]}
    assert cs.detect_cost_columns(["id", "name"]) == {}


def test_null_groups_keep_their_rows(spark):
    rows = [(None, "2024-01-01", 1), ("g", None, 2), ("g", "2024-01-02", 3), (None, "2024-01-03", 4)]
    df = spark.createDataFrame(rows, "g string, d string, id int").withColumn("d", F.col("d").cast("date"))
    assert wn.prior_running_sum(df, ["g"], ["d", "id"], "id", F.col("d")).count() == 4
    out = {r.id: r.prev_id for r in wn.previous_in_order(df, ["g"], ["d", "id"], ["id"], F.col("d")).collect()}
    assert set(out) == {1, 2, 3, 4} and out[4] == 1


def test_open_and_reversed_intervals(spark):
    spans = spark.createDataFrame([("a", "2024-01-30 00:00:00", "2024-02-02 00:00:00"), ("b", "2024-01-01 00:00:00", None),
                                ("c", "2024-03-01 00:00:00", "2024-02-01 00:00:00")], "id string, s string, e string")
    spans = spans.select("id", F.col("s").cast("timestamp_ntz").alias("s"), F.col("e").cast("timestamp_ntz").alias("e"))
    out = [(r.id, r.month, r.overlap_minutes) for r in ru.split_by_month(spans, "s", "e").orderBy("id", "month").collect()]
    assert out == [("a", dt.date(2024, 1, 1), 2880), ("a", dt.date(2024, 2, 1), 1440), ("b", None, None), ("c", None, None)]
    pts = spark.createDataFrame([("2023-12-31 23:00:00",), ("2024-01-05 00:00:00",), ("2024-06-01 00:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    inside = iv.point_in_interval(pts, "t", spans, "s", "e", how="left_semi")
    assert inside.count() == 2


def test_profile_treats_nan_as_null_and_survives_large_values(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2 ** 62), (float("nan"), 2 ** 62), (None, 2 ** 62)], "`x.y` double, n long")
    p = {r.column_name: r for r in pf.numeric_profile(df, ["x.y", "n"], exact_median=False).collect()}
    assert (p["x.y"]["count"], p["x.y"].null_count, p["x.y"].max) == (2, 2, 2.0)
    assert p["n"]["sum"] == float(3 * 2 ** 62 + 1)
    big = spark.createDataFrame([(1e30,), (1.0,)], "v double")
    assert pf.numeric_profile(big, exact_median=False).first()["sum"] == 1e30
    report = {(r[0], r[1]): r for r in dq.dq_report(df.withColumnRenamed("x.y", "xy")).collect()}
    assert "50.0" in str(report["xy", "null_pct"])


def test_decisions_and_queue(spark):
    log = spark.createDataFrame([(1, 1, "approve", 1), (1, 2, "revoke", 2), (2, 3, "odd", 1), (3, 4, "hold", 1)],
                                "calculation_id int, decision_id int, decision string, decided_at int")
    assert {r.calculation_id: r.state for r in lg.fold_decisions(log).collect()} == {1: "revoked", 2: "unknown", 3: "pending"}
    calcs = spark.createDataFrame([(1, 1, "t", "success"), (2, 1, "t", "success"), (3, 1, "t", "success")], "id int, query_id int, executed_at string, execution_status string")
    appr = spark.createDataFrame([(1, 1, "pending", True), (2, 2, "pending", False), (3, 2, "approved", False)],
                                 "id int, calculation_id int, request_status string, requires_escalation boolean")
    assert {r.calculation_id: r.requires_escalation for r in lg.approval_queue(calcs, appr).collect()} == {1: True, 3: None}


def test_registry_names_in_any_case(spark):
    reg = lg.registry_frame(spark, [("Lease", "rent", ["a"])])
    df = spark.createDataFrame([("LEASE",), ("other",)], "document_type string")
    assert {r.document_type: r.resolved_type for r in lg.resolve_types(df, "document_type", reg).collect()} == {"LEASE": "lease", "other": "custom"}


def test_only_queries_over_given_tables(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/p")
    t = {"edge_t": spark.range(5)}
    assert ex.run_sql(spark, "WITH x AS (SELECT id FROM edge_t) SELECT * FROM x WHERE id > 2;", t).count() == 2
    with pytest.raises(ValueError):
        ex.run_sql(spark, "WITH x AS (SELECT id FROM edge_t) INSERT INTO edge_t SELECT * FROM x", t)
    with pytest.raises(Exception):
        ex.run_sql(spark, f"SELECT * FROM parquet.`{tmp_path}/p`", t)
    assert not spark.catalog.tableExists("edge_t")


def test_response_cache_keeps_all_records(spark, tmp_path):
    a, b = ({"content": c, "model": "m"} for c in ("one", "two"))
    (tmp_path / "k1.json").write_text(json.dumps(a) + "\n" + json.dumps(b) + "\n")
    (tmp_path / "k2.json").write_text(json.dumps(a, indent=2))
    got = sorted((r.cache_key, r.content) for r in fs.read_response_cache(spark, str(tmp_path)).collect())
    assert got == [("k1", "one"), ("k1", "two"), ("k2", "one")]
