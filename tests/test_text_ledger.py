"""Text-table helpers and ledger operators on small frames."""

import hashlib

from pyspark.sql import functions as F

from covenant.operators import costs as cs
from covenant.operators import ledger as lg
from covenant.operators import text as tx


def test_table_names(spark):
    names = ["1_1787301669.219506_sample_billing_data.csv", "Incidents_API_Service.csv", "My-File name.PARQUET",
             "noext"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = [r[0] for r in df.select(tx.table_name(F.col("f"))).collect()]
    assert got == ["sample_billing_data", "incidents_api_service", "my_file_name", "noext"]


def test_prompt_key_matches_python_and_null_system(spark):
    df = spark.createDataFrame([("sys", "hello"), (None, "hello")], "s string, p string")
    got = [r[0] for r in df.select(tx.prompt_key(F.col("s"), F.col("p"))).collect()]
    assert got == [hashlib.sha256(b"sys||hello").hexdigest(), hashlib.sha256(b"||hello").hexdigest()]


def test_json_status(spark):
    rows = ['{"a": 1}', 'Sure!\n{"a": {"b": 2}}\nbye', "", None, "no json", '{"a": 1, broken {']
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    got = [r[0] for r in df.select(tx.json_status(F.col("c"))).collect()]
    assert got == ["direct", "extracted", "empty", "empty", "unparseable", "unparseable"]


def test_lint(spark):
    df = spark.createDataFrame([("SELECT a, b_x FROM t WHERE c > 1 AND a IS NULL",)], "q string")
    r = df.select(F.concat_ws(",", tx.lint_words(F.col("q"), ["a", "C"])).alias("w"),
                  F.concat_ws(",", tx.lint_position(F.col("q"), ["a", "C"])).alias("p")).first()
    assert r["w"] == "b_x,t"           # table name is a known false positive of the word lint
    assert r["p"] == "B_X,NULL,T"      # position lint keeps NULL (not in its keyword list)


def test_fold_decisions_hold_keeps_pending(spark):
    log = spark.createDataFrame(
        [(1, 10, "hold", "2024-01-01 00:00:00"), (2, 11, "approve", "2024-01-01 00:00:00"),
         (3, 11, "hold", "2024-01-02 00:00:00"), (4, 12, "approve", "2024-01-01 00:00:00"),
         (5, 12, "reject", "2024-01-01 00:00:00")],
        "decision_id long, calculation_id long, decision string, decided_at string") \
        .withColumn("decided_at", F.col("decided_at").cast("timestamp_ntz"))
    got = {r["calculation_id"]: r["state"] for r in lg.fold_decisions(log).collect()}
    assert got == {10: "pending", 11: "approved", 12: "rejected"}   # same time → higher id wins


def test_cost_delta_union_of_keys(spark):
    o = spark.createDataFrame([("a", 10.0), ("b", 5.0)], "cost_type string, amount double")
    c = spark.createDataFrame([("b", 7.0), ("c", 1.0)], "cost_type string, amount double")
    got = {r["cost_type"]: r["delta"] for r in cs.cost_delta(o, c).collect()}
    assert got == {"a": -10.0, "b": 2.0, "c": 1.0}


def test_detect_cost_columns():
    cols = ["penalty_monetary", "x_credits", "late_fee", "duration", "discount"]
    d = cs.detect_cost_columns(cols)
    assert d == {"monetary": ["penalty_monetary"], "credits": ["x_credits"], "hours": ["duration"]}


def test_proof_summary_null_currency_is_usd(spark):
    df = spark.createDataFrame([("m", None, 1.0, 2.0, 1.0), ("m", "EUR", 1.0, 3.0, 2.0)],
                               "cost_type string, cost_currency string, original_cost double, "
                               "calculated_cost double, delta_cost double")
    got = {(r["level"], r["key"]): r["calculated"] for r in cs.proof_summary(df).collect()}
    assert got == {("total", "*"): 5.0, ("by_type", "m"): 5.0, ("by_currency", "USD"): 2.0,
                   ("by_currency", "EUR"): 3.0}
