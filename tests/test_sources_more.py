"""File forms: JSON arrays by default, bulk text files, unknown extensions, file profiles; limits and attainment."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from covenant.operators import rules as ru
from covenant.operators import text as tx
from covenant.sources import files as fs


@pytest.mark.parametrize("name, body, n", [
    ("array.json", json.dumps([{"a": 1}, {"a": 2}]), 2), ("pretty.json", json.dumps([{"a": 1}, {"a": 2}, {"a": 3}], indent=2), 3),
    ("lines.json", '{"a": 1}\n{"a": 2}\n', 2), ("object.json", json.dumps({"a": 1, "b": {"c": 2}}, indent=1), 1), ("one.json", '\n  {"a": 1}', 1),
    ("lines.jsonl", '{"a": 1}\n\n{"a": 5}', 2)])
def test_json_forms_by_default(spark, tmp_path, name, body, n):
    (tmp_path / name).write_text(body)
    df = fs.read_data(spark, str(tmp_path / name))
    assert "_corrupt_record" not in df.columns and df.count() == n and df.agg(F.sum("a")).first()[0] >= n


def test_unknown_extension(spark, tmp_path):
    (tmp_path / "x.doc").write_text("a")
    with pytest.raises(ValueError, match="unsupported data file format '.doc'"):
        fs.read_data(spark, str(tmp_path / "x.doc"))


def test_bulk_documents(spark, tmp_path):
    rows = [("a.txt", "one\n\ntwo \x1e three\n"), ("b", ""), ("c", None), ("é", "naïve\r\n"), ("a.txt", "again")]
    fs.write_documents(spark.createDataFrame(rows, "filename string, text_content string"), str(tmp_path / "bulk"))
    got = sorted((r.filename, r.text_content, r.file_size) for r in fs.read_bulk_documents(spark, str(tmp_path / "bulk")).collect())
    assert got == sorted((n, t or "", len((t or "").encode())) for n, t in rows)
    with pytest.raises(Exception, match="end mark"):
        fs.write_documents(spark.createDataFrame([("x", "bad\x1e\n")], "filename string, text_content string"), str(tmp_path / "bad"))


def test_one_file_per_document(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("")
    got = {r.filename: (r.file_size, r.text_content) for r in fs.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == (7, "one\ntwo")


def test_file_profile(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,when,name\n2,2024-01-02,b\n1,2024-01-01,a\n")
    r = fs.file_profile(spark, str(tmp_path / "x.csv"), ["id"], rows=1).first()
    assert (r.file_name, r.file_size, r.headers, r.total_rows, r.row_count) == ("x.csv", 43, ["id", "when", "name"], 2, 1)
    assert json.loads(r.sample_data[0])["name"] == "a"


def test_limits_from_the_most_specific_row(spark):
    limits = spark.createDataFrame([(None, None, 60, 500), (None, "high", 15, None), ("db", None, None, 400), ("db", "high", None, 90), ("db", "high", 5, 95)],
                                   "service string, severity string, response int, resolution int")
    rows = [("db", "high"), ("db", "low"), ("web", "high"), ("web", None), (None, "high"), (None, None)]
    out = ru.with_limits(spark.createDataFrame(rows, "service string, severity string"), limits, ["service", "severity"], ["response", "resolution"])
    assert [tuple(r) for r in out.collect()] == [
        ("db", "high", 5, 90), ("db", "low", 60, 400), ("web", "high", 15, 500), ("web", None, 60, 500), (None, "high", 15, 500), (None, None, 60, 500)]
    assert out.count() == len(rows)


def test_attainment_of_empty_months(spark):
    day = dt.date
    meas = spark.createDataFrame([(1, day(2024, 1, 5), 90.0), (1, day(2024, 1, 6), 100.0), (1, day(2024, 3, 1), 99.5), (2, day(2024, 2, 1), None), (9, day(2024, 2, 1), 1.0)],
                                 "c int, d date, v double")
    rules = spark.createDataFrame([(1, "r1", "up", 99.0, "<", 5.0, 1.0), (1, "r2", "up", 96.0, "<", 10.0, 1.0), (1, "rx", "other", 100.0, "<", 50.0, 1.0)],
                                  "c int, rule_id string, metric string, threshold double, threshold_operator string, penalty_percentage double, penalty_amount double")
    periods = spark.createDataFrame([(1, day(2024, 1, 10), day(2024, 3, 31)), (2, day(2024, 2, 1), day(2024, 2, 1))], "c int, first_month date, last_month date")
    out = ru.monthly_attainment(meas, rules, periods, ["c"], "d", "v", "up").orderBy("c", "month").collect()
    assert [(r.c, r.month, r.measurements, r.average, r.rule_id, r.credit_pct) for r in out] == [
        (1, day(2024, 1, 1), 2, 95.0, "r2", 10.0), (1, day(2024, 2, 1), 0, None, None, None), (1, day(2024, 3, 1), 1, 99.5, None, 0.0), (2, day(2024, 2, 1), 0, None, None, None)]


def test_prompt_with_and_without_schema(spark):
    df = spark.createDataFrame([("p", None, "doc", "Table"), ("p", "i", "doc", None)], "b string, i string, d string, s string")
    with_s, without = [r[0] for r in df.select(tx.full_prompt(F.col("b"), F.col("i"), F.col("d"), F.col("s"))).collect()]
    assert with_s.endswith("described above.\nTable") and without.endswith("described above.")
    assert df.select(tx.preview(F.lit("x" * 500))).first()[0] == "x" * 200
