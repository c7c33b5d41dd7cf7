"""Strict lint of SQL texts: no finding inside literals, comments, aliases or table names."""

import pytest
from pyspark.sql import functions as F

from covenant.operators import sqltext as st
from covenant.operators import text as tx

COLUMNS = ["uptime", "penalty", "month", "order date"]
CASES = [
    ("SELECT uptime FROM billing WHERE penalty > 5", []),
    ("select Uptime, missing from billing", ["column MISSING"]),
    ("SELECT 'no such words here' AS note, \"order date\" FROM billing -- nor here\n/* nor here */", []),
    ("SELECT uptime AS u, penalty p FROM billing b WHERE b.uptime > 1 ORDER BY u, p", []),
    ("SELECT b.nope, x.uptime FROM billing AS b", ["column NOPE", "qualifier X"]),
    ("WITH w AS (SELECT uptime, sum(penalty) AS s FROM billing GROUP BY uptime) SELECT w.s, t.uptime FROM w JOIN billing t ON w.uptime = t.uptime", []),
    ("SELECT max(uptime), my_fn(penalty, ghost) FROM billing", ["column GHOST"]),
    ("SELECT CASE WHEN uptime < 5 THEN 'low' ELSE 'high' END grade FROM billing, other_table", ["table OTHER_TABLE"]),
    ("SELECT s.uptime FROM (SELECT uptime FROM billing) s WHERE EXISTS (SELECT 1 FROM billing q WHERE q.penalty = s.uptime)", []),
    ("SELECT uptime FROM billing WHERE month > DATE '2024-01-01' - INTERVAL '3' DAYS", []),
    ("SELECT `uptime`, `ghost col` FROM `billing`", ["column GHOST COL"]),
    ("SELECT 'it''s fine, really' x, penalty FROM db.billing", ["table DB"]),
    ("SELECT uptime, row_number() OVER (PARTITION BY month ORDER BY penalty DESC NULLS LAST) AS rn FROM billing", []),
    ("", []), ("not sql at all ' \" (", ["column ALL", "column AT", "column SQL"]), (None, None),
]


def test_findings(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CASES)], "i int, s string")
    got = {r.i: r.f for r in df.select("i", st.lint_names(F.col("s"), COLUMNS, ["billing"]).alias("f")).collect()}
    for i, (sql, want) in enumerate(CASES):
        if i not in (11, 14):
            assert got[i] == want, sql
    assert "table DB" in got[11] and not any("FINE" in x for x in got[11])
    assert "column SQL" in got[14]


def test_the_plain_lint_reports_what_the_strict_one_does_not(spark):
    sql = "SELECT 'weak words' AS note, b.uptime FROM billing b"
    df = spark.createDataFrame([(sql,)], "s string")
    plain, strict = df.select(tx.lint_words(F.col("s"), COLUMNS), st.lint_names(F.col("s"), COLUMNS)).first()
    assert {"weak", "words", "note", "b", "billing"} <= set(plain) and strict == []


@pytest.mark.parametrize("text", ["a" * 5000, "SELECT " + ", ".join(f"c{i}" for i in range(300)) + " FROM t"])
def test_long_texts(spark, text):
    out = spark.createDataFrame([(text,)], "s string").select(st.lint_names(F.col("s"), ["c1"])).first()[0]
    assert len(out) in (1, 299)


def test_statements_are_dealt_by_their_number(spark, monkeypatch):
    from covenant.plans import adapters as A
    monkeypatch.setattr(A, "STATEMENTS_PER_TASK", 10)
    log = A.statement_log(spark, "/root/testdata/sf0.001")
    sizes = [r[0] for r in log.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == log.count() and len(sizes) >= sum(sizes) // 10 and max(sizes) <= 20
