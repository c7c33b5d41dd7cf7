"""Driver contract, every registered query at sf0.001, plan shape checks."""

import duckdb
import pytest

import __spark_entry__ as E
from covenant.plans.adapters import TABLES
from covenant.plans.registry import ORACLE, QUERIES
from tests.conftest import SF_ORACLE, SF_SMALL
from tools.check_oracle import digest


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_ORACLE}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["rows_analyzed"] > 0


def test_oracle_keys_are_registered():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_ORACLE)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name in ORACLE:
        cur = duck.execute(ORACLE[name])
        want = cur.fetchall()
        columns = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(columns) and len(rows) == len(want)
        assert digest(df.columns, rows)[0] == digest(columns, want)[0]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop(spark):
    for name, fn in QUERIES.items():
        if name in {"csv_roundtrip", "json_roundtrip", "text_docs", "cache_scan", "ledger_append",
                    "results_write", "cache_upsert", "stream_row_penalty"}:
            continue
        plan = _plan(fn(spark, SF_SMALL))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name   # JVM-side only


def test_rule_eval_broadcasts_ladders(spark):
    from covenant.plans.q_rules import violations
    plan = _plan(violations(spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan


def test_filters_reach_the_scan(spark):
    df = E.queries()["parquet_scan"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), IsNotNull(l_returnflag), GreaterThanOrEqual(l_shipdate" in plan \
        or "GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_returnflag:string,l_shipdate" in plan


def _family(t: str) -> str:
    t = t.lower()
    for prefix, fam in (("decimal", "decimal"), ("array", "list")):
        if t.startswith(prefix):
            return fam
    if t.endswith("[]"):
        return "list"
    return {"bigint": "int64", "int": "int32", "integer": "int32", "smallint": "int16", "double": "float64",
            "float": "float32", "string": "str", "varchar": "str", "boolean": "bool", "date": "date",
            "timestamp_ntz": "ts", "timestamp": "ts"}.get(t, t)


def test_result_types_match_oracle(spark, duck):
    """Spark result types agree with the DuckDB oracle's (LIMIT 0 there)."""
    io = {"csv_roundtrip", "json_roundtrip", "text_docs", "cache_scan", "ledger_append", "results_write",
          "cache_upsert", "stream_row_penalty"}
    bad = []
    for name, sql in ORACLE.items():
        if name in io:
            continue
        st = {c: _family(t) for c, t in QUERIES[name](spark, SF_SMALL).dtypes}
        cur = duck.execute(f"SELECT * FROM ({sql}) q LIMIT 0")
        dt = {c[0]: _family(str(c[1])) for c in cur.description}
        bad += [(name, c, st[c], dt.get(c)) for c in st if st[c] != dt.get(c)]
    assert not bad, bad
