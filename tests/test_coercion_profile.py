"""Coercion gate and profile edge rows."""

from pyspark.sql import functions as F

from covenant.operators import coercion as co
from covenant.operators import profile as pf
from covenant.operators import quality as dq


def test_gate_is_strict_at_80_percent(spark):
    rows = [(str(i),) for i in range(8)] + [("x",), ("y",)]           # exactly 0.8
    d = {r["column_name"]: r["detected_type"] for r in co.decide(spark.createDataFrame(rows, "v string")).collect()}
    assert d["v"] == "string"
    rows.append(("9",))                                                 # 9/11 > 0.8
    d = {r["column_name"]: r["detected_type"] for r in co.decide(spark.createDataFrame(rows, "v string")).collect()}
    assert d["v"] == "numeric"


def test_ratio_counts_nulls_in_denominator(spark):
    rows = [("1",), ("2",), ("3",), ("4",), (None,)]                    # 4/5 = 0.8 → not numeric
    d = co.decide(spark.createDataFrame(rows, "v string")).first()
    assert d["detected_type"] == "string" and d["numeric_ratio"] == 0.8


def test_mixed_case_booleans_and_all_null(spark):
    df = spark.createDataFrame([("Yes", None), ("NO", None), ("yes", None)], "b string, e string")
    # three distinct raw values → not boolean (≤ 2 distinct rule)
    d = {r["column_name"]: r["detected_type"] for r in co.decide(df).collect()}
    assert d == {"b": "string", "e": "string"}
    df2 = spark.createDataFrame([("Yes",), ("NO",), (None,)], "b string")
    out, dec = co.coerce(df2)
    assert dec == {"b": "boolean"}
    assert [r["b"] for r in out.collect()] == [True, False, None]


def test_datetime_needs_iso_prefix(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-02-01 10:00:00",), ("2024-03-03T08:00:00",), ("12",)],
                               "v string")
    d = co.decide(df).first()
    assert (d["detected_type"], d["datetime_ratio"]) == ("string", 0.75)


def test_empty_frame(spark):
    df = spark.createDataFrame([], "v string, n double")
    assert co.decide(df).first()["detected_type"] == "string"
    rep = dq.dq_report(df).collect()
    assert [(r["check"], r["severity"]) for r in rep] == [("has_results", "warning")]


def test_value_labels(spark):
    vals = ["true", "1", "12", "1.5", "2024-01-01", "2024/01/01 10:00:00", "n/a", "abc", "5-LOW"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(co.value_label(F.col("v"))).collect()]
    assert got == ["boolean", "boolean", "integer", "float", "date", "date", "string", "string", "string"]


def test_string_profile_distinct_and_length(spark):
    long_text = "x" * 500
    df = spark.createDataFrame([(long_text,), (long_text,), ("a",), (None,)], "t string")
    r = pf.string_profile(df).first()
    assert (r["count"], r["null_count"], r["unique_values"], r["max_length"]) == (3, 1, 2, 500)


def test_dq_checks_fire(spark):
    df = spark.createDataFrame([(1, -5.0, "k", None), (1, 2e10, "k", None), (2, 1.0, "k", "z")],
                               "user_id long, amount double, c string, mostly_null string")
    rep = {(r["column_name"], r["check"]): r for r in dq.dq_report(df).collect()}
    assert rep[("user_id", "id_duplicates")]["value"] == 1.0
    assert ("amount", "negative_values") in rep and ("amount", "very_large_values") in rep
    assert ("c", "constant") in rep
    assert rep[("mostly_null", "null_pct")]["severity"] == "warning"
    st = dq.dq_status(dq.dq_report(df)).first()
    assert st["sanity_status"] == "warning"
