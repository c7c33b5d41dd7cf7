"""Digest trees and proofs: brute-force roots, tampering, membership, location of changes."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from covenant.operators import proofs as pr

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def root_of(lines, leaf):
    """(depth, root) of a calculation's lines by the tree's definition."""
    entries = Counter(map(sha, lines))
    depth = sum(len(entries) > leaf * 16 ** d for d in range(8))
    nodes = defaultdict(list)
    for h, n in entries.items():
        nodes[h[:depth]].append(f"{h}:{n}")
    digests = {p: sha("\n".join(sorted(e))) for p, e in nodes.items()}
    for d in range(depth, 0, -1):
        up = defaultdict(list)
        for p, x in digests.items():
            up[p[:d - 1]].append(f"{p[-1]}:{x}")
        digests = {p: sha("\n".join(sorted(e))) for p, e in up.items()}
    return depth, digests[""]


@pytest.fixture(scope="module")
def ledger(spark):
    rng = random.Random(6)
    texts = {c: [f"line {rng.randrange(10 ** 6)} of {c}" for _ in range(n)] for c, n in ((1, 1), (2, 3), (3, 40), (4, 900), (5, 3000))}
    texts[4] += texts[4][:5] * 3                              # equal lines
    rows = [(c, t) for c, ts in texts.items() for t in ts]
    lines = spark.createDataFrame(rows, "calculation_id int, line string").groupBy("calculation_id", "line").agg(F.count(F.lit(1)).alias("count"))
    return texts, lines


@pytest.mark.parametrize("leaf", [2, 10, 512])
def test_roots(ledger, leaf):
    texts, lines = ledger
    tree = pr.digest_tree(lines, pr.depths(lines, leaf))
    got = {r.calculation_id: (r.lines_depth, r.lines_root) for r in pr.roots(tree).collect()}
    assert got == {c: root_of(t, leaf) for c, t in texts.items()}
    if leaf == 2:
        assert max(d for d, _ in got.values()) == 3 and tree.agg(F.max(F.size("entries"))).first()[0] < 20


def test_inclusion(spark, ledger):
    texts, lines = ledger
    tree = pr.digest_tree(lines, pr.depths(lines, 4))
    asked = [(c, t) for c, ts in texts.items() for t in ts[:7]] + [(c, "forged") for c in texts] + [(3, texts[4][0]), (99, "x")]
    paths = pr.inclusion_proof(spark.createDataFrame(asked, "calculation_id int, line string"), tree)
    assert {len(r.path) for r in paths.where("calculation_id = 5").collect()} == {pr.roots(tree).where("calculation_id = 5").first().lines_depth + 1}
    got = {(r.calculation_id, r.line): r.included for r in pr.check_inclusion(paths, pr.roots(tree)).collect()}
    assert got == {(c, t): t in texts[c] for c, t in asked if c in texts}
    other = pr.roots(tree).withColumn("lines_root", F.sha2(F.lit("x"), 256))
    assert not any(r.included for r in pr.check_inclusion(paths, other).collect())
    bent = paths.withColumn("path", F.transform("path", lambda s: F.struct(s["prefix"].alias("prefix"), F.slice(s["entries"], 1, 1).alias("entries"))))
    assert not all(r.included for r in pr.check_inclusion(bent, pr.roots(tree)).where("line <> 'forged' and calculation_id = 4").collect())


def test_altered_lines_are_located(spark, ledger):
    texts, lines = ledger
    levels = pr.depths(lines, 4)
    gone, once = texts[5][17], texts[4][0]
    changed = lines.where(F.col("line") != gone).withColumn("count", F.when(F.col("line") == once, 1).otherwise(F.col("count")))
    changed = changed.union(spark.createDataFrame([(2, "new line", 2)], lines.schema))
    got = {tuple(r) for r in pr.altered_lines(pr.digest_tree(lines, levels), pr.digest_tree(changed, levels)).collect()}
    assert got == {(5, sha(gone), texts[5].count(gone), 0), (4, sha(once), texts[4].count(once), 1), (2, sha("new line"), 0, 2)}
    assert pr.altered_lines(pr.digest_tree(lines, levels), pr.digest_tree(lines, levels)).count() == 0


def parts(spark):
    make = spark.createDataFrame
    approvals = make([(1, 10, "approved", 7, None, 'said "ok"', False), (2, 11, "approved", None, None, None, True), (3, 12, "rejected", 7, None, None, False)],
                     "id int, calculation_id int, request_status string, approved_by int, approval_date timestamp_ntz, approver_comments string, requires_escalation boolean")
    calculations = make([(c, 5, "success", 30, [f"r{i}" for i in range(30)], "passed", None) for c in (10, 11, 12)],
                        "id int, query_id int, execution_status string, result_rows_count int, result_data array<string>, sanity_check_status string, sanity_check_details string")
    queries = make([(5, 3, "SELECT 1", 0.5, None)], "id int, document_id int, query_text string, extraction_confidence double, extracted_terms string")
    documents = make([(3, "f.txt", "sla", None)], "id int, filename string, document_type string, upload_date timestamp_ntz")
    users = make([(7, "ann", "ann@example.com")], "id int, username string, email string")
    costs = make([(10, "1.5", None, None, t, "u", "0.5", "1.0", None, None) for t in ("a", "a", "b", None)],
                 "calculation_id int, calculated_cost string, cost_currency string, cost_details string, cost_type string, cost_unit string, "
                 "delta_cost string, original_cost string, period_end date, period_start date")
    return approvals, calculations, queries, documents, users, costs.withColumns({c: F.col(c).cast("decimal(18,4)") for c in ("calculated_cost", "delta_cost", "original_cost")})


def test_heads_and_verification(spark):
    *tables, costs = parts(spark)
    lines = pr.proof_lines(costs)
    heads = pr.proof_heads(*tables, costs, pr.roots(pr.digest_tree(lines, pr.depths(lines, 2))))
    rows = {r.approval_id: r for r in heads.collect()}
    assert set(rows) == {1, 2} and tuple(heads.columns) == pr.HEAD_FIELDS
    assert (rows[1].by_type, rows[1].by_currency, rows[1].cost_lines) == (
        "=1.0000/1.5000/0.5000,a=2.0000/3.0000/1.0000,b=1.0000/1.5000/0.5000", "USD=6.0000", 4)
    assert rows[1].sample_evidence == "\n".join(f"r{i}" for i in range(20)) and rows[1].approver_email == "ann@example.com"
    assert (rows[2].cost_lines, rows[2].lines_root, rows[2].approved_by, rows[2].by_type) == (0, sha(""), None, "")

    hashed = pr.with_proof_hash(heads)
    stored = spark.createDataFrame(hashed.collect(), hashed.schema)
    check = lambda h, ls=lines: {r.approval_id: (r.head_ok, r.lines_ok, r.verified) for r in pr.verify(h, ls).collect()}
    assert check(stored) == {1: (True, True, True), 2: (True, True, True)}
    variants = None
    for field, kind in heads.dtypes:
        other = F.when(F.col(field).isNull(), F.lit("1")).otherwise(F.concat(F.lit("1"), F.col(field).cast("string"))).cast(kind) \
            if kind != "boolean" else ~F.col(field)
        one = stored.withColumn(field, other).withColumn("altered", F.lit(field)).withColumnRenamed("proof_hash", "old")
        variants = one if variants is None else variants.union(one)
    assert pr.with_proof_hash(variants).where("proof_hash = old").select("altered").collect() == []
    assert check(stored.withColumn("proof_hash", F.lit(None).cast("string")))[1] == (False, True, False)
    assert check(stored, lines.where("line not like '%\"b\"%'"))[1] == (True, False, False)
    assert check(stored, lines.withColumn("count", F.lit(1)))[1][1] is False
    added = spark.createDataFrame([(11, "x", 1)], lines.schema)
    assert check(stored, lines.union(added))[2][1] is False


def test_no_lines_at_all(spark):
    *tables, costs = parts(spark)
    lines = pr.proof_lines(costs.where("false"))
    heads = pr.proof_heads(*tables, costs.where("false"), pr.roots(pr.digest_tree(lines, pr.depths(lines))))
    assert [r.cost_lines for r in heads.collect()] == [0, 0]
    assert all(r.verified for r in pr.verify(pr.with_proof_hash(heads), lines).collect())
