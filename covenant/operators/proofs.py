"""Proof documents with a digest tree over their cost lines (AUD-3..5).

A proof's head is one row; its cost lines stay rows of their own. The lines of
a calculation are digested by a tree: a leaf holds the lines whose SHA-256
begins with the same hex digits, and every inner node the digests of its up to
16 children. The number of digits, the tree's depth, follows from the number of
lines, so a leaf holds about ``LEAF_LINES`` lines and no node grows with the
calculation. The root and the depth are fields of the head, and the proof's
hash is that of the head alone:

* one line's membership is shown by its leaf and the nodes above it
  (``inclusion_proof``), without the other lines;
* after a change, only the nodes whose digests differ are compared
  (``altered_lines``), which names the lines that came and went.

Equal lines of a calculation are one entry with their count. A calculation
without lines has the root of an empty leaf. Null fields are kept as nulls.

Trees are built from the lines' hashes, not their texts, and the hashes are
shuffled once, by calculation (``line_parts``): counts, leaves, inner
nodes and comparisons follow in the same partitions. Calculations of over
``HOT_LINES`` lines are built apart, dealt by hash too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.session import written

LEAF_LINES = 512
#: Lines of a calculation up to which one task builds its tree, and a row may hold it.
HOT_LINES = 4096
FAN_OUT = 16
SAMPLE_ROWS = 20
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"

#: FIXED VALUES of a proof's metadata.
METADATA = {"system_version": "1.0", "generation_method": "automated", "compliance_scope": "financial,operational,audit"}

LINE_FIELDS = ("calculated_cost", "cost_currency", "cost_details", "cost_type", "cost_unit", "delta_cost", "original_cost",
               "period_end", "period_start")
HEAD_FIELDS = ("approval_date", "approval_id", "approved_by", "approver_comments", "approver_email", "by_currency", "by_type",
               "calculation_id", "compliance_scope", "contract_terms", "cost_lines", "document_id", "document_type",
               "execution_status", "filename", "generation_method", "lines_depth", "lines_root", "query_confidence",
               "requires_escalation", "rows_processed", "sample_evidence", "sanity_check_details", "sanity_check_status",
               "sql_query", "system_version", "total_calculated", "total_delta", "total_original", "upload_date")


def _json(fields: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in fields]), {"ignoreNullFields": "false"})


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"      # SHA-256 of no bytes


def line_texts(costs: DataFrame) -> DataFrame:
    """(calculation_id, line): every cost line as canonical JSON."""
    return costs.select("calculation_id", _json(LINE_FIELDS).alias("line"))


def proof_lines(costs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(calculation_id, line, count): the cost lines as canonical JSON, equal ones once.

    With ``wanted``, only the lines of its calculations, with its other columns.
    The texts are written after grouping and joining; fields whose equal texts
    may stand for different values are grouped by their texts.
    """
    plain = ("string", "date", "boolean", "tinyint", "smallint", "int", "bigint")
    keys = [F.col(c) if k in plain or k.startswith("decimal") else F.col(c).cast("string").alias(c)
            for c, k in costs.select(*LINE_FIELDS).dtypes]
    out = costs.select("calculation_id", *keys).groupBy("calculation_id", *LINE_FIELDS).agg(F.count(F.lit(1)).alias("count"))
    more = []
    if wanted is not None:
        out = out.join(wanted, "calculation_id")
        more = [c for c in wanted.columns if c != "calculation_id"]
    return out.select("calculation_id", _json(LINE_FIELDS).alias("line"), "count", *more)


def line_hashes(costs: DataFrame, dealt: bool = True) -> DataFrame:
    """(calculation_id, h, count): SHA-256 of each different line, as bytes; lines without a calculation are left out.

    ``dealt``: shuffled once by calculation, so that what follows by calculation needs no other shuffle.
    """
    h = costs.where("calculation_id is not null").select("calculation_id", F.unhex(digest(_json(LINE_FIELDS))).alias("h"))
    return (h.repartition("calculation_id") if dealt else h).groupBy("calculation_id", "h").agg(F.count(F.lit(1)).alias("count"))


def line_parts(costs: Sequence[DataFrame], hot_lines: int = HOT_LINES) -> tuple[list[list[DataFrame]], int]:
    """The line hashes of each of the cost frames, in one or two parts, and the lines of the largest calculation in all.

    The first part has the calculations with at most ``hot_lines`` lines in all
    frames, dealt by calculation; the second, where there are any, the others:
    at most one for so many lines, left to later shuffles.
    """
    n = reduce(DataFrame.union, [c.select("calculation_id") for c in costs]).where("calculation_id is not null")
    n = n.groupBy("calculation_id").agg(F.count(F.lit(1)).alias("n"))
    most = n.agg(F.max("n")).first()[0] or 0
    if most <= hot_lines:
        return [[line_hashes(c) for c in costs]], most
    ids = F.broadcast(written(n.where(F.col("n") > hot_lines).select("calculation_id"), "proof-hot"))
    of = lambda how: [c.join(ids, "calculation_id", how) for c in costs]
    return [[line_hashes(c) for c in of("left_anti")], [line_hashes(c, dealt=False) for c in of("left_semi")]], most


def over_calculations(costs: Sequence[DataFrame], then: Callable[..., DataFrame], hot_lines: int = HOT_LINES) -> DataFrame:
    """``then(*hashes, most, whole)`` for each of the ``line_parts``, put together.

    ``most``: lines of the largest calculation or more; ``whole``: whether a row may hold a calculation's tree.
    """
    parts, most = line_parts(costs, hot_lines)
    return reduce(DataFrame.union, [then(*part, most if i else min(most, hot_lines), i == 0) for i, part in enumerate(parts)])


def depth_of(n: Column, leaf_lines: int = LEAF_LINES) -> Column:
    depth = F.lit(0)
    for d in range(8):
        depth = depth + (n > leaf_lines * FAN_OUT ** d).cast("int")
    return depth


def top_depth(most: int, leaf_lines: int = LEAF_LINES) -> int:
    return sum(most > leaf_lines * FAN_OUT ** d for d in range(8))


def depths(lines: DataFrame, leaf_lines: int = LEAF_LINES) -> DataFrame:
    """(calculation_id, lines_depth): the fewest levels with at most ``leaf_lines`` different lines a leaf, by expectation."""
    n = lines.groupBy("calculation_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("calculation_id", depth_of(F.col("n"), leaf_lines).alias("lines_depth"))


def tree_steps(lines: DataFrame, levels: DataFrame, top: int | None = None) -> list[DataFrame]:
    """The tree's nodes (calculation_id, prefix, lines_depth, entries, digest): all leaves, then the nodes above them step by step.

    A leaf's entries are ``<line hash>:<count>``, an inner node's ``<next digit>:<child digest>``, both sorted.
    ``lines`` has the lines' texts (``line``) or hashes (``h``); ``top`` is the
    greatest depth or more, read from ``levels`` where it is not given.
    """
    if "h" in lines.columns:
        h = lines.join(levels, "calculation_id").withColumn("h", F.lower(F.hex("h")))
    else:
        h = lines.select("calculation_id", digest(F.col("line")).alias("h"), "count").join(levels, "calculation_id")

    def node(df: DataFrame, prefix: Column, item: Column) -> DataFrame:
        g = df.groupBy("calculation_id", "lines_depth", prefix.alias("prefix")).agg(F.array_sort(F.collect_list(item)).alias("entries"))
        return g.withColumn("digest", digest(F.array_join("entries", "\n")))

    if top is None:
        top = levels.agg(F.coalesce(F.max("lines_depth"), F.lit(0))).first()[0]
    steps = [node(h, F.expr("left(h, lines_depth)"), F.concat_ws(":", "h", F.col("count").cast("string")))]
    for _ in range(top):
        steps.append(node(steps[-1].where("prefix <> ''"), F.expr("left(prefix, length(prefix) - 1)"), F.concat_ws(":", F.right("prefix", F.lit(1)), "digest")))
    return steps


def digest_tree(lines: DataFrame, levels: DataFrame, top: int | None = None) -> DataFrame:
    """All nodes of ``tree_steps``; the node of prefix '' is the root."""
    return reduce(DataFrame.union, tree_steps(lines, levels, top))


def roots(tree: DataFrame | Sequence[DataFrame]) -> DataFrame:
    """The roots of a tree or of its steps."""
    steps = [tree] if isinstance(tree, DataFrame) else tree
    return reduce(DataFrame.union, [t.where("prefix = ''").select("calculation_id", "lines_depth", F.col("digest").alias("lines_root")) for t in steps])


def cost_summary(costs: DataFrame) -> DataFrame:
    """Totals per calculation, by type and by currency (none: USD), as canonical texts ``key=amounts`` in key order.

    Amounts are summed per (calculation, type, currency) first, so a hot calculation is reduced where it lies.
    """
    money = lambda c: F.sum(c).cast("decimal(28,4)")
    cells = costs.groupBy("calculation_id", F.coalesce("cost_type", F.lit("")).alias("t"), F.coalesce("cost_currency", F.lit("USD")).alias("c")).agg(
        F.count(F.lit(1)).alias("n"), money("original_cost").alias("o"), money("calculated_cost").alias("k"), money("delta_cost").alias("d"))
    text = lambda key, *amounts: F.concat_ws("=", key, F.concat_ws("/", *[F.coalesce(F.col(a), F.lit(0)).cast("decimal(28,4)").cast("string") for a in amounts]))
    joined = lambda items: F.array_join(F.array_sort(items), ",")
    # the cells of a calculation, far fewer than its lines, are dealt once; types, then calculations, are grouped there
    add = lambda a, x: (a + F.coalesce(x["k"], F.lit(0))).cast("decimal(28,4)")
    types = cells.repartition("calculation_id").groupBy("calculation_id", "t").agg(
        F.sum("n").alias("n"), money("o").alias("o"), money("k").alias("k"), money("d").alias("d"), F.collect_list(F.struct("c", "k")).alias("c"))
    total = types.groupBy("calculation_id").agg(
        F.sum("n").alias("cost_lines"), money("o").alias("total_original"), money("k").alias("total_calculated"), money("d").alias("total_delta"),
        joined(F.collect_list(text(F.col("t"), "o", "k", "d"))).alias("by_type"), F.flatten(F.collect_list("c")).alias("c"))
    currency = lambda c: F.concat_ws("=", c, F.aggregate(
        F.filter("c", lambda x: x["c"] == c), F.lit(0).cast("decimal(28,4)"), add).cast("string"))
    by_currency = joined(F.transform(F.array_distinct(F.transform("c", lambda x: x["c"])), currency))
    return total.withColumn("by_currency", by_currency).drop("c")


def proof_heads(approvals: DataFrame, calculations: DataFrame, queries: DataFrame, documents: DataFrame, users: DataFrame,
                costs: DataFrame, root: DataFrame) -> DataFrame:
    """AUD-3: one row per approved approval with all fields of ``HEAD_FIELDS``.

    ``root`` has the digest root and depth of each calculation's lines.
    """
    a = approvals.where("request_status = 'approved'").select(
        F.col("id").alias("approval_id"), "calculation_id", F.col("approved_by").alias("_by"), F.date_format("approval_date", ISO_SECONDS).alias("approval_date"),
        "approver_comments", "requires_escalation")
    c = calculations.select(F.col("id").alias("calculation_id"), "query_id", "execution_status", F.col("result_rows_count").alias("rows_processed"),
                            F.array_join(F.slice("result_data", 1, SAMPLE_ROWS), "\n").alias("sample_evidence"), "sanity_check_status", "sanity_check_details")
    q = queries.select(F.col("id").alias("query_id"), "document_id", F.col("query_text").alias("sql_query"),
                       F.col("extraction_confidence").alias("query_confidence"), F.col("extracted_terms").alias("contract_terms"))
    d = documents.select(F.col("id").alias("document_id"), "filename", "document_type", F.date_format("upload_date", ISO_SECONDS).alias("upload_date"))
    u = users.select(F.col("id").alias("_by"), F.col("username").alias("approved_by"), F.col("email").alias("approver_email"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(28,4)").alias(c)
    # all by calculation first, so that its rows are dealt once
    p = (a.join(c, "calculation_id").join(cost_summary(costs), "calculation_id", "left").join(root, "calculation_id", "left")
         .join(q.join(d, "document_id"), "query_id").join(u, "_by", "left"))
    done = {"cost_lines": F.coalesce("cost_lines", F.lit(0)).cast("bigint").alias("cost_lines"),
            "lines_depth": F.coalesce("lines_depth", F.lit(0)).cast("int").alias("lines_depth"),
            "lines_root": F.coalesce("lines_root", F.lit(EMPTY_ROOT)).alias("lines_root"),
            "by_type": F.coalesce("by_type", F.lit("")).alias("by_type"), "by_currency": F.coalesce("by_currency", F.lit("")).alias("by_currency"),
            **{t: zero(t) for t in ("total_original", "total_calculated", "total_delta")}, **{k: F.lit(v).alias(k) for k, v in METADATA.items()}}
    return p.select(*[done.get(f, F.col(f)) for f in HEAD_FIELDS])


def with_proof_hash(heads: DataFrame) -> DataFrame:
    """AUD-4: the hash of the head's canonical JSON (fields as texts, in sorted order, nulls kept)."""
    return heads.withColumn("proof_hash", digest(_json(HEAD_FIELDS)))


def verify(heads: DataFrame, lines: DataFrame | Sequence[DataFrame], stored: str = "proof_hash") -> DataFrame:
    """AUD-5: whether the head has the stored hash and the lines have the head's root; a missing hash never verifies.

    The lines' tree is built with the depth that the head records. Lines may
    come in parts with calculations of their own. The heads are computed once.
    """
    heads = written(heads.withColumn("head_ok", F.coalesce(digest(_json(HEAD_FIELDS)) == F.col(stored), F.lit(False))), "proof-heads")
    levels = heads.select("calculation_id", "lines_depth").distinct()
    top = levels.agg(F.coalesce(F.max("lines_depth"), F.lit(0))).first()[0]
    parts = [lines] if isinstance(lines, DataFrame) else lines
    found = reduce(DataFrame.union, [roots(tree_steps(part, levels, top)) for part in parts])
    j = heads.join(found.select("calculation_id", F.col("lines_root").alias("_root")), "calculation_id", "left")
    lines_ok = F.coalesce(F.coalesce("_root", F.lit(EMPTY_ROOT)) == F.col("lines_root"), F.lit(False))
    return j.withColumn("lines_ok", lines_ok).withColumn("verified", F.col("head_ok") & F.col("lines_ok")).drop("_root")


def inclusion_proof(requests: DataFrame, tree: DataFrame | Sequence[DataFrame], whole: bool = False) -> DataFrame:
    """Per request (calculation_id, line) its path: nodes (prefix, entries) from the leaf to the root.

    ``tree``: all nodes, or the steps of ``tree_steps``. With ``whole``, for small
    calculations, a row takes a step's nodes and all stays dealt by calculation.
    Requests for calculations without lines return nothing.
    """
    steps = [tree] if isinstance(tree, DataFrame) else list(tree)
    depth = steps[0].select("calculation_id", F.col("lines_depth").alias("_depth")).distinct()
    asked = requests.select("calculation_id", "line").distinct().withColumn("_h", digest(F.col("line"))).join(depth, "calculation_id")
    if whole:
        for up, nodes in enumerate(steps):
            of = nodes.groupBy("calculation_id").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "entries"))).alias(f"_{up}"))
            asked = asked.join(of, "calculation_id", "left")
        at = F.sequence(F.col("_depth"), F.lit(0), F.lit(-1))
        entries = lambda p: F.coalesce(*[F.try_element_at(f"_{up}", p) for up in range(len(steps))])
        node = lambda p: F.struct(p.alias("prefix"), entries(p).alias("entries"))
        return asked.select("calculation_id", "line", F.transform(F.transform(at, lambda i: F.col("_h").substr(F.lit(1), i)), node).alias("path"))
    at = F.transform(F.sequence(F.lit(0), F.col("_depth")), lambda i: F.expr("_h").substr(F.lit(1), i))
    nodes = reduce(DataFrame.union, steps).select("calculation_id", "prefix", "entries")
    step = F.struct((-F.length("prefix")).alias("up"), F.col("prefix"), F.col("entries"))
    path = (asked.withColumn("prefix", F.explode(at)).join(nodes, ["calculation_id", "prefix"], "left")
            .groupBy("calculation_id", "line").agg(F.array_sort(F.collect_list(step)).alias("path")))
    return path.select("calculation_id", "line", F.transform("path", lambda s: F.struct(s["prefix"].alias("prefix"), s["entries"].alias("entries"))).alias("path"))


def check_inclusion(paths: DataFrame, root: DataFrame) -> DataFrame:
    """(calculation_id, line, included): each node's digest must stand in the node above, the last must be the recorded root."""
    h = digest(F.col("line"))
    join = lambda e: F.sha2(F.array_join(e, "\n").cast("binary"), 256)
    start = F.struct(F.lit(True).alias("ok"), h.alias("want"))

    def step(acc: Column, s: Column) -> Column:
        here = F.exists(s["entries"], lambda e: F.startswith(e, F.concat(acc["want"], F.lit(":"))))
        above = F.exists(s["entries"], lambda e: e == F.concat_ws(":", h.substr(F.length(s["prefix"]) + 1, F.lit(1)), acc["want"]))
        leaf = acc["want"] == h
        return F.struct((acc["ok"] & F.coalesce(F.when(leaf, here).otherwise(above), F.lit(False))).alias("ok"),
                        F.coalesce(join(s["entries"]), F.lit("")).alias("want"))

    walked = F.aggregate("path", start, step)
    j = paths.join(root.select("calculation_id", "lines_root"), "calculation_id")
    return j.select("calculation_id", "line", (walked["ok"] & (walked["want"] == F.col("lines_root"))).alias("included"))


def altered_lines(stored: DataFrame, current: DataFrame, whole: bool = False) -> DataFrame:
    """What changed between two trees of the same depths: (calculation_id, line_hash, before, after) counts.

    Only leaves with different digests are opened. With ``whole``, for small
    calculations, rows take a calculation's leaves and all stays dealt by calculation.
    """
    none = F.array().cast("array<string>")
    side = lambda only, was: F.transform(only, lambda e: F.struct(e.alias("e"), F.lit(was).alias("was")))
    changed = lambda ea, eb: F.concat(side(F.array_except(ea, eb), True), side(F.array_except(eb, ea), False))
    leaf = F.length("prefix") == F.col("lines_depth")
    if whole:
        leaves = F.map_from_entries(F.collect_list(F.struct("prefix", F.struct("digest", "entries"))))
        a, b = [t.where(leaf).groupBy("calculation_id").agg(leaves.alias(m)) for t, m in ((stored, "_a"), (current, "_b"))]
        keys = lambda m: F.coalesce(F.map_keys(m), none)
        at = lambda m, p: F.try_element_at(m, p)
        differ = F.filter(F.array_union(keys("_a"), keys("_b")), lambda p: ~at("_a", p)["digest"].eqNullSafe(at("_b", p)["digest"]))
        entries = lambda m, p: F.coalesce(at(m, p)["entries"], none)
        gone = a.join(b, "calculation_id", "full").select("calculation_id", F.explode(F.flatten(
            F.transform(differ, lambda p: changed(entries("_a", p), entries("_b", p))))).alias("x"))
    else:
        key = ["calculation_id", "prefix"]
        a = stored.where(leaf).select(*key, F.col("digest").alias("_a"), F.col("entries").alias("_ea"))
        b = current.where(leaf).select(*key, F.col("digest").alias("_b"), F.col("entries").alias("_eb"))
        differ = a.join(b, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
        gone = differ.select("calculation_id", F.explode(changed(F.coalesce("_ea", none), F.coalesce("_eb", none))).alias("x"))
    part = F.split("x.e", ":")
    count = lambda was: F.coalesce(F.sum(F.when(F.col("x.was") == was, part[1].cast("bigint"))), F.lit(0))
    return gone.groupBy("calculation_id", part[0].alias("line_hash")).agg(count(True).alias("before"), count(False).alias("after"))
