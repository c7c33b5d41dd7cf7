"""Trees from line hashes, in parts by the size of a calculation: the same results, with one shuffle of the hashes."""

import pytest
from pyspark.sql import functions as F

from covenant.operators import proofs as pr


@pytest.fixture(scope="module")
def costs(spark):
    rows = [(c, f"{i % (n - 1)}.5", None if i % 3 else "EUR", "t") for c, n in ((1, 3), (2, 40), (3, 700)) for i in range(n)] + [(None, "1", None, "t")]
    df = spark.createDataFrame(rows, "calculation_id int, calculated_cost string, cost_currency string, cost_type string")
    none = {c: F.lit(None).cast("string") for c in pr.LINE_FIELDS if c not in df.columns}
    return df.withColumns(none | {"calculated_cost": F.col("calculated_cost").cast("decimal(18,4)")})


@pytest.mark.parametrize("hot_lines", [0, 50, 4096])
def test_parts_give_the_same(costs, hot_lines):
    lines = pr.proof_lines(costs)
    levels = pr.depths(lines, 4)
    tree = pr.digest_tree(lines, levels)
    steps = lambda h, most: pr.tree_steps(h, pr.depths(h, 4), pr.top_depth(most, 4))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(pr.over_calculations([costs], lambda h, most, whole: pr.roots(steps(h, most)), hot_lines)) == rows(pr.roots(tree))

    asked = pr.line_texts(costs).union(pr.line_texts(costs).withColumn("line", F.concat("line", F.lit(" ")))).distinct()
    paths = pr.over_calculations([costs], lambda h, most, whole: pr.inclusion_proof(asked, steps(h, most), whole), hot_lines)
    assert rows(paths) == rows(pr.inclusion_proof(asked, tree))
    assert rows(pr.check_inclusion(paths, pr.roots(tree)).where("included").select("calculation_id", "line")) == rows(
        lines.where("calculation_id is not null").select("calculation_id", "line"))

    less = costs.where("calculated_cost <> 0.5")
    def compare(a, b, most, whole):
        levels, top = pr.depths(a, 4), pr.top_depth(most, 4)
        return pr.altered_lines(pr.tree_steps(a, levels, top)[0], pr.tree_steps(b, levels, top)[0], whole)
    found = pr.over_calculations([costs, less], compare, hot_lines)
    assert rows(found) == rows(pr.altered_lines(tree, pr.digest_tree(pr.proof_lines(less), levels))) and found.count() > 3


def _dealt(df):
    return [x.split(", ENSURE")[0] for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]


def test_texts_and_nodes_are_not_shuffled(spark, costs):
    import __spark_entry__ as E
    for name in ("proof_altered", "proof_inclusion"):
        dealt = _dealt(E.queries()[name](spark, "/root/testdata/sf0.001"))
        assert dealt and not [x for x in dealt if "prefix" in x or "line#" in x], name


def test_summary_deals_cells_once(spark):
    rows = [(1, "a", "EUR", "1.0", None), (1, "a", None, "2.0", "0.5"), (1, "b", "EUR", "4.0", "1.0"), (1, None, "USD", None, None), (2, None, None, None, None)]
    costs = spark.createDataFrame(rows, "calculation_id int, cost_type string, cost_currency string, calculated_cost string, delta_cost string").select(
        "calculation_id", "cost_type", "cost_currency", *[F.col(c).cast("decimal(18,4)") for c in ("calculated_cost", "delta_cost")],
        F.lit("1").cast("decimal(18,4)").alias("original_cost"))
    summary = pr.cost_summary(costs)
    got = {r.calculation_id: (r.cost_lines, r.by_type, r.by_currency) for r in summary.collect()}
    assert got == {1: (4, "=1.0000/0.0000/0.0000,a=2.0000/3.0000/0.5000,b=1.0000/4.0000/1.0000", "EUR=5.0000,USD=2.0000"), 2: (1, "=1.0000/0.0000/0.0000", "USD=0.0000")}
    assert len(_dealt(pr.cost_summary(costs))) == 2
