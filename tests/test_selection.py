"""Two-scan profiles: exact medians inside a bracket, statistics as one long table, odd names."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from covenant.operators import profile as pf
from covenant.operators import quality as dq
from covenant.operators import selection as sel


def medians(df, cols):
    return {r.column_name: r.median for r in pf.numeric_profile(df, cols).collect()}


def test_infinities_and_many_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(5_001)] + [(inf, None), (-inf, None), (inf, 3.0)], "a double, b double")
    p = {r.column_name: r for r in pf.numeric_profile(df, ["a", "b"]).collect()}
    assert p["a"].median == 2500.5 and p["a"].max == inf and p["b"].median == 3.0
    mostly = spark.createDataFrame([(v,) for v in [inf] * 60 + [-inf] * 30 + [1.0] * 5], "a double")
    assert medians(mostly, ["a"]) == {"a": inf}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_median_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    hot = [7.0] * 3000                                   # a third of the rows share one value
    vals = hot + [rnd.uniform(-50, 50) for _ in range(6000)] + [rnd.gauss(0, 1) * 10 ** rnd.randrange(-300, 300) for _ in range(1 + seed % 2)]
    rnd.shuffle(vals)
    rows = [(v, float(int(v)) if abs(v) < 1e15 else None, None if i % 3 else v, i) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "`a.1` double, b double, c double, d long").repartition(5)
    want = {c: statistics.median([r[j] for r in rows if r[j] is not None]) for j, c in enumerate(["a.1", "b", "c", "d"])}
    got = medians(df, ["a.1", "b", "c", "d"])
    assert got == {c: round(v, 6) for c, v in want.items()}


def test_few_rows(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert medians(df, ["a", "b"]) == {"a": 1.5}
    assert medians(df.limit(0), ["a", "b"]) == {}
    assert pf.numeric_profile(df, []).count() == 0


def test_a_wrong_bracket_fails_loudly(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("a"))
    grouped = sel.cells(df, {"a": F.col("a")}, {"a": (80.0, 90.0, 100)})
    with pytest.raises(Exception, match="outside its bracket"):
        sel.medians(grouped, {"a": (80.0, 90.0, 100)}).collect()


def test_the_second_scan_groups_the_middle_only(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("a"))
    lo, _, hi = df.agg(sel.middle_bracket(F.col("a"))).first()[0]
    assert sel.cells(df, {"a": F.col("a")}, {"a": (lo, hi, 10_000)}).count() < 150


def test_column_statistics_with_odd_names(spark):
    df = spark.createDataFrame([(1, 2.5, "x", True, None), (2, None, "y" * 100, None, None), (2, 4.0, "x", False, None)],
                               "`i.d` int, `a``b` double, `c d` string, e boolean, f double")
    df = df.withColumn("g.h", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")).withColumn("arr", F.array(F.lit(1)))
    got = {(r.column_name, r.stat): r.value if r.text is None else r.text for r in pf.column_statistics(df).collect()}
    assert got["i.d", "median"] == 2.0 and got["a`b", "median"] == 3.25 and got["a`b", "null_count"] == 1.0
    assert got["c d", "unique_values"] == 2.0 and got["c d", "max_length"] == 100.0 and got["e", "true"] == 1.0
    assert got["g.h", "min"] == "2024-01-01 10:00:00" and got["g.h", "range_days"] == 0.0 and got["arr", "count"] == 3.0
    assert ("f", "median") not in got and got["f", "count"] == 0.0 and got["*", "total_columns"] == 7.0
    assert pf.datetime_profile(df).count() == 1 and pf.string_profile(df).first().unique_values == 2
    assert {(r.value, r["count"]) for r in pf.boolean_counts(df).collect()} == {(True, 1), (False, 1)}
    empty = {(r.column_name, r.stat): r.value for r in pf.column_statistics(df.limit(0)).collect()}
    assert empty["c d", "unique_values"] == 0.0 and ("i.d", "min") not in empty


def test_distinct_pass_only_where_a_check_can_fire(spark):
    """Same report as counting every column; a column with nulls or few values gets no exact count."""
    df = spark.createDataFrame([(i, i % 3, f"u{i}", f"r{i % 9}", "same", None if i == 5 else f"n{i}", f"v{i}" if i else "v1", 2e10) for i in range(400)],
                               "id long, group_id int, `u.x` string, rep string, const string, nul string, almost string, big double")
    report = {(r.column_name, r["check"]): r.value for r in dq.dq_report(df).collect()}
    assert report == {("*", "total_nulls"): 1.0, ("group_id", "id_duplicates"): 397.0, ("u.x", "all_unique"): 400.0, ("const", "constant"): 1.0,
                      ("nul", "null_pct"): 0.25, ("big", "very_large_values"): 2e10}
    clear = spark.createDataFrame([(f"r{i % 9}", None if i else "x") for i in range(100)], "a string, b string")
    assert "Aggregate" not in dq.dq_report(clear)._jdf.queryExecution().optimizedPlan().toString()
