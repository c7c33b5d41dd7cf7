"""Ledger tables: joins along the proof chain, approval folding, dashboards
(JN-1..4/8, AUD-1/2/6..9, FLT-3/6..9, AGG-14/21).

Joins are written against pre-aggregated sides (one row per key) so a 1:n
fan-out never multiplies a wide row; dimension tables with a fixed size
are broadcast, everything else is left to the planner and AQE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant import terms
from covenant.operators import execution as ex
from covenant.operators.joins import broadcast_if_small

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def trailing_days(df: DataFrame, col: str, as_of: str, days: int) -> DataFrame:
    """FLT-3: rows from ``as_of - days`` on; ``as_of`` is a parameter, not the clock."""
    return df.filter(F.col(col) >= F.date_sub(F.lit(as_of).cast("date"), days))


def filter_costs(df: DataFrame, cost_type: str | None = None, start: str | None = None,
                 end: str | None = None) -> DataFrame:
    """FLT-8: by type and by period overlap with [start, end]."""
    out = df
    if cost_type is not None:
        out = out.filter(F.col("cost_type") == cost_type)
    if end is not None:
        out = out.filter(F.col("period_start") <= F.lit(end).cast("date"))
    if start is not None:
        out = out.filter(F.col("period_end") >= F.lit(start).cast("date"))
    return out


def proof_chain(approvals: DataFrame, calculations: DataFrame, queries: DataFrame,
                documents: DataFrame) -> DataFrame:
    """JN-1: approval → calculation → query → document (inner, FK)."""
    a = approvals.filter(F.col("request_status") == "approved").select(
        F.col("id").alias("approval_id"), "calculation_id", "approval_date")
    c = calculations.select(F.col("id").alias("calculation_id"), "query_id", "execution_status")
    q = queries.select(F.col("id").alias("query_id"), "document_id")
    dd = documents.select(F.col("id").alias("document_id"), "filename", "document_type")
    return (a.join(c, "calculation_id").join(q, "query_id").join(dd, "document_id")
            .select("approval_id", "calculation_id", "query_id", "document_id", "filename", "document_type",
                    "execution_status", "approval_date"))


def cost_totals_per_calculation(costs: DataFrame) -> DataFrame:
    return costs.groupBy("calculation_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("calculated_cost").alias("calc"), F.sum("delta_cost").alias("delta"))


def costs_per_calculation(calculations: DataFrame, costs: DataFrame) -> DataFrame:
    """JN-2: every calculation with its (pre-aggregated) cost lines."""
    k = cost_totals_per_calculation(costs)
    return (calculations.select(F.col("id").alias("calculation_id")).join(k, "calculation_id", "left")
            .select("calculation_id", F.coalesce("lines", F.lit(0)).cast("bigint").alias("cost_lines"),
                    F.col("calc").cast("double").alias("calculated"), F.col("delta").cast("double").alias("delta")))


def with_approver(approvals: DataFrame, users: DataFrame) -> DataFrame:
    """JN-3: nullable approver (left join)."""
    u = users.select(F.col("id").alias("approved_by"), F.col("username").alias("_u"), F.col("email").alias("_e"))
    return (approvals.join(u, "approved_by", "left")
            .select(F.col("id").alias("approval_id"), "request_status", F.col("_u").alias("approved_by"),
                    F.col("_e").alias("approver_email")))


def queries_per_document(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """JN-4: documents with their query counts (zero when none)."""
    q = queries.groupBy(F.col("document_id")).agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("validation_status") == "valid").alias("valid_queries"))
    return (documents.select(F.col("id").alias("document_id")).join(q, "document_id", "left")
            .select("document_id", F.coalesce("queries", F.lit(0)).alias("queries"),
                    F.coalesce("valid_queries", F.lit(0)).alias("valid_queries")))


def runs_per_query(queries: DataFrame, calculations: DataFrame) -> DataFrame:
    """AUD-9: runs per query and the latest run (by time, then id)."""
    ordk = F.struct("executed_at", "id")
    runs = calculations.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("runs"), F.max_by("id", ordk).alias("latest_run"),
        F.max_by("execution_status", ordk).alias("latest_status"))
    return (queries.select(F.col("id").alias("query_id")).join(runs, "query_id", "left")
            .select("query_id", F.coalesce("runs", F.lit(0)).alias("runs"), "latest_run", "latest_status"))


def registry_frame(spark, extra: Sequence[tuple[str, str, list[str]]] = ()) -> DataFrame:
    rows = [(n, d, k) for n, d, k in terms.DOCUMENT_TYPES] + list(extra)
    return spark.createDataFrame(rows, "name string, description string, expected_outputs array<string>")


def resolve_types(df: DataFrame, type_col: str, registry: DataFrame | None = None) -> DataFrame:
    """JN-8: document type → registry entry, unknown types fall back to the
    generic one. Names are matched in lower case; of entries with one name the
    last description counts. Broadcast only after a check of the size."""
    reg = registry if registry is not None else registry_frame(df.sparkSession)
    generic = next(r for r in terms.DOCUMENT_TYPES if r[0] == terms.GENERIC_TYPE)
    r = (reg.groupBy(F.lower("name").alias("_name")).agg(F.max(F.struct("description", "expected_outputs")).alias("_e"))
         .select("_name", F.col("_e.description").alias("_desc"), F.col("_e.expected_outputs").alias("_exp")))
    j = df.join(broadcast_if_small(r), F.lower(F.col(type_col)) == F.col("_name"), "left")
    return (j.withColumn("resolved_type", F.coalesce(F.col("_name"), F.lit(generic[0])))
             .withColumn("type_description", F.coalesce(F.col("_desc"), F.lit(generic[1])))
             .withColumn("expected_outputs", F.coalesce(F.col("_exp"), F.array(*[F.lit(x) for x in generic[2]])))
             .drop("_name", "_desc", "_exp"))


def approval_queue(calculations: DataFrame, approvals: DataFrame) -> DataFrame:
    """AUD-1: successful calculations whose latest approval (greatest id) is
    still pending, or for which none has been opened (escalation unknown: null)."""
    c = calculations.filter(F.col("execution_status") == "success").select(
        F.col("id").alias("calculation_id"), "query_id", "executed_at")
    a = approvals.groupBy("calculation_id").agg(F.max_by(F.struct("request_status", "requires_escalation"), "id").alias("_a"))
    return (c.join(a, "calculation_id", "left").filter(F.col("_a").isNull() | F.coalesce(F.col("_a.request_status") == "pending", F.lit(True)))
            .select(*c.columns, F.col("_a.requires_escalation").alias("requires_escalation")))


DECISION_STATE = {"approve": "approved", "reject": "rejected", "escalate": "escalated", "revoke": "revoked"}


def fold_decisions(log: DataFrame, key: str = "calculation_id") -> DataFrame:
    """AUD-2: current state per calculation from its decision log; ``hold``
    changes nothing; the latest other decision wins by (time, id); a decision
    that is none of these is reported as ``unknown``, not as pending."""
    not_hold = F.col("decision") != "hold"
    last = F.max_by(F.when(not_hold, F.col("decision")),
                    F.when(not_hold, F.struct("decided_at", "decision_id")))
    g = log.groupBy(key).agg(last.alias("_d"), F.max(F.when(not_hold, F.col("decided_at"))).alias("decided_at"),
                             F.count(F.lit(1)).alias("decisions"))
    state = F.when(F.col("_d").isNull(), F.lit("pending")).otherwise(F.lit("unknown"))
    for dec, st in reversed(list(DECISION_STATE.items())):
        state = F.when(F.col("_d") == dec, F.lit(st)).otherwise(state)
    return g.select(key, state.alias("state"), "decided_at", "decisions")


def proof_id(approval_id: Column, at: Column) -> Column:
    """AUD-6: first 16 hex of sha256(approval id || ISO time); time is an input."""
    return F.substring(F.sha2(F.concat(approval_id.cast("string"), F.date_format(at, ISO_SECONDS)), 256),
                       1, terms.PROOF_ID_HEX_CHARS)


def search_proofs(chain: DataFrame, document_ids: Sequence[int] | None = None, approval_id: int | None = None,
                  start: str | None = None, end: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """FLT-7 + LIM-3: optional filters, then stable paging by approval id."""
    out = chain
    if document_ids:
        out = out.filter(F.col("document_id").isin(list(document_ids)))
    if approval_id is not None:
        out = out.filter(F.col("approval_id") == approval_id)
    if start:
        out = out.filter(F.col("approval_date") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out.filter(F.col("approval_date") < F.lit(end).cast("timestamp_ntz"))
    return ex.page(out, ["approval_id"], limit=limit, offset=offset)


def active_approvers(users: DataFrame, approvals: DataFrame) -> DataFrame:
    """FLT-6/9: active approvers and how many approvals each signed."""
    signed = (approvals.filter(F.col("request_status") == "approved").groupBy("approved_by")
              .agg(F.count(F.lit(1)).alias("approvals_signed")))
    u = users.filter(F.col("is_active") & (F.col("role") == "approver")).select("id", "username")
    return (u.join(signed, u["id"] == signed["approved_by"], "left")
            .select("id", "username", F.coalesce("approvals_signed", F.lit(0)).alias("approvals_signed")))


def status_counts(sources: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """AGG-21: rows per status for several ledgers, one partial aggregate each."""
    out = None
    for entity, df, col in sources:
        g = df.groupBy(F.col(col).alias("status")).agg(F.count(F.lit(1)).alias("n")) \
              .select(F.lit(entity).alias("entity"), "status", "n")
        out = g if out is None else out.unionByName(g)
    return out


def dashboard(documents: DataFrame, calculations: DataFrame, approvals: DataFrame, costs: DataFrame,
              as_of: str, days: int = 7) -> DataFrame:
    """AGG-14: one row of counters from several tables — each table
    contributes partial sums to one union, aggregated once (no joins
    between the one-row results)."""
    a = F.lit(as_of).cast("timestamp_ntz")
    appr = approvals.filter(F.col("request_status") == "approved").select(
        "calculation_id", ((F.col("approval_date") > a - F.expr(f"INTERVAL {days} DAYS"))
                           & (F.col("approval_date") <= a)).alias("recent"))
    rec = costs.groupBy("calculation_id").agg(F.sum("delta_cost").alias("d")).join(appr, "calculation_id")
    z = F.lit(0).cast("bigint")
    zd = F.lit(0).cast("decimal(28,4)")
    parts = [
        documents.select(F.lit(1).cast("bigint").alias("documents"), z.alias("calculations"), z.alias("pending"),
                         z.alias("completed"), zd.alias("total"), zd.alias("recent")),
        calculations.select(z.alias("documents"), F.lit(1).cast("bigint").alias("calculations"), z.alias("pending"),
                            z.alias("completed"), zd.alias("total"), zd.alias("recent")),
        approvals.select(z.alias("documents"), z.alias("calculations"),
                         (F.col("request_status") == "pending").cast("bigint").alias("pending"),
                         (F.col("request_status") == "approved").cast("bigint").alias("completed"),
                         zd.alias("total"), zd.alias("recent")),
        rec.select(z.alias("documents"), z.alias("calculations"), z.alias("pending"), z.alias("completed"),
                   (-F.col("d")).cast("decimal(28,4)").alias("total"),
                   F.when(F.col("recent"), -F.col("d")).otherwise(0).cast("decimal(28,4)").alias("recent")),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(F.sum("documents").alias("documents"), F.sum("calculations").alias("calculations"),
                 F.sum("pending").alias("pending_approvals"), F.sum("completed").alias("completed_proofs"),
                 F.sum("total").cast("double").alias("total_recovery"),
                 F.sum("recent").cast("double").alias("recent_recovery"))
