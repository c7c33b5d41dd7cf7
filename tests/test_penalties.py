"""Goldens computed in plain Python from the billing fixture."""

import statistics

import pytest
from pyspark.sql import functions as F

from covenant.operators import penalties as pen
from covenant.operators import profile as pf
from tests.fixtures import BILLING, billing_df

UPTIME = [r[1] for r in BILLING]
RESPONSE = [r[2] for r in BILLING]


def uptime_penalty(u, order):
    """The amount of the first tier, in the given order of bounds, that ``u`` is below."""
    amounts = {95.0: 2500.0, 98.0: 1500.0, 98.9: 1000.0, 99.0: 500.0}
    return next((amounts[b] for b in order if u < b), 0.0)


UP = [uptime_penalty(u, [95.0, 98.0, 98.9, 99.0]) for u in UPTIME]
MILD = [uptime_penalty(u, [99.0, 98.9, 98.0, 95.0]) for u in UPTIME]
RT = [1000.0 if r > 10 else 500.0 if r > 5 else 200.0 if r > 2 else 0.0 for r in RESPONSE]


@pytest.fixture(scope="module")
def billing(spark, tmp_path_factory):
    return billing_df(spark, tmp_path_factory.mktemp("billing")).cache()


def test_csv_is_coerced(billing):
    types = dict(billing.dtypes)
    assert types["uptime_percent"] == "double"
    assert types["incident_date"] == "timestamp_ntz"
    assert billing.count() == 31


def test_tier_sums(billing):
    up = pen.uptime_tier_penalty(F.col("uptime_percent"))
    dead = pen.uptime_tier_penalty(F.col("uptime_percent"), most_severe_first=False)
    rt = pen.response_tier_penalty(F.col("avg_response_time"))
    r = billing.agg(F.sum(up), F.sum(dead), F.sum(rt)).first()
    assert tuple(r) == (sum(UP), sum(MILD), sum(RT)) and 0 < sum(MILD) < sum(UP)


def test_violation_summary_rows_and_cells(billing):
    t = billing.select(pen.uptime_tier_penalty(F.col("uptime_percent")).alias("uptime_penalty"),
                       pen.response_tier_penalty(F.col("avg_response_time")).alias("response_penalty"))
    s = pen.violation_summary(pen.with_row_penalty(t)).first()
    assert (s["violating_rows"], s["total_penalty"], s["rows_analyzed"]) == (sum(a + b > 0 for a, b in zip(UP, RT)), sum(UP) + sum(RT), 31)
    c = pen.proof_violation_rate(t).first()
    cells = sum(x > 0 for x in UP + RT)
    assert c["violating_cells"] == cells
    assert c["violation_rate_pct"] == pytest.approx(cells / 31 * 100, abs=1e-4)


def test_proportional_sums(billing):
    r = billing.agg(F.round(F.sum(pen.uptime_proportional(F.col("uptime_percent"))), 6),
                    F.round(F.sum(pen.response_proportional(F.col("avg_response_time"))), 6)).first()
    assert tuple(r) == pytest.approx((sum((100 - u) * 100 for u in UPTIME if u < 99), sum((x - 2) * 50 for x in RESPONSE if x > 2)))


def test_numeric_profile_matches_goldens(billing):
    p = {r["column_name"]: r for r in pf.numeric_profile(billing, ["uptime_percent", "transaction_count"]).collect()}
    u = p["uptime_percent"]
    assert u["mean"] == pytest.approx(statistics.fmean(UPTIME), abs=1e-6)
    assert u["median"] == pytest.approx(statistics.median(UPTIME))
    assert u["std"] == pytest.approx(statistics.stdev(UPTIME), abs=1e-6)
    assert p["transaction_count"]["sum"] == float(sum(r[4] for r in BILLING))


def test_nan_penalty_is_not_a_violation(spark):
    df = spark.createDataFrame([(float("nan"),), (5.0,), (None,), (-1.0,)], "x_penalty double")
    s = pen.violation_summary(pen.with_row_penalty(df)).first()
    assert (s["violating_rows"], s["total_penalty"]) == (1, 5.0)


def test_rule_labels(spark):
    df = spark.createDataFrame([(500.0, 0.0), (0.0, 0.0), (0.0, 200.0)], "uptime_penalty double, response_penalty double")
    r = pen.with_rule_labels(pen.with_row_penalty(df)).collect()
    assert [x["violated_rules"] for x in r] == ["Uptime SLA", "No violations", "Response Time SLA"]
    assert [x["status"] for x in r] == ["VIOLATION", "Compliant", "VIOLATION"]
