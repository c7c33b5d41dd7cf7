"""Declared schemas of the system tables, conforming frames and integrity checks.

``conform`` brings a frame to a table's declared columns; ``integrity`` counts, for
a set of tables, rows without a key, surplus rows of a key or unique value, and
references to rows that are not there: one unpivoted aggregate a table and one
anti join a reference.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.operators.profile import distinct_key


@dataclass(frozen=True)
class Table:
    """Columns as (name, type); the key is ``id``."""
    columns: tuple[tuple[str, str], ...]
    unique: tuple[str, ...] = ()
    references: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, object] = field(default_factory=dict)


def _table(columns: str, unique: str = "", references: str = "", **defaults) -> Table:
    named = tuple(tuple(c.split()) for c in columns.split(","))
    return Table(named, tuple(unique.split()), dict(r.split(">") for r in references.split()), defaults)


# FIXED VALUES: the system tables' columns, in their order (JSON documents are texts; times are without a zone), with the
# columns that must be unique, the tables that columns refer to, and constant defaults.
SYSTEM_TABLES = {
    "users": _table("id bigint, username string, email string, role string, is_active boolean, created_at timestamp_ntz, updated_at timestamp_ntz",
                    "username email", role="reviewer", is_active=True),
    "documents": _table("id bigint, filename string, document_type string, file_path string, text_content string, uploaded_by bigint, "
                        "upload_date timestamp_ntz, file_size bigint, mime_type string, status string, error_message string, doc_metadata string, "
                        "created_at timestamp_ntz, updated_at timestamp_ntz", "", "uploaded_by>users", document_type="custom", status="pending"),
    "custom_prompts": _table("id bigint, name string, description string, document_type string, prompt_text string, is_active boolean, created_by bigint, "
                             "created_at timestamp_ntz, updated_at timestamp_ntz, usage_count bigint, prompt_metadata string",
                             "", "created_by>users", is_active=True, usage_count=0),
    "queries": _table("id bigint, document_id bigint, query_text string, query_type string, extraction_confidence double, prompt_used string, "
                      "prompt_text string, model_used string, extracted_terms string, custom_instructions string, is_validated boolean, "
                      "validation_status string, validation_errors string, created_at timestamp_ntz, updated_at timestamp_ntz",
                      "", "document_id>documents", is_validated=False),
    "calculations": _table("id bigint, query_id bigint, execution_status string, result_rows_count bigint, result_columns string, "
                           "result_column_types string, result_data string, all_results_file string, execution_time_ms double, error_message string, "
                           "sanity_check_status string, sanity_check_details string, sla_rules string, violation_summary string, "
                           "summary_statistics string, data_metadata string, table_name string, source_file string, created_at timestamp_ntz, "
                           "updated_at timestamp_ntz", "", "query_id>queries", result_rows_count=0),
    "cost_breakdowns": _table("id bigint, calculation_id bigint, cost_type string, cost_currency string, original_cost double, calculated_cost double, "
                              "delta_cost double, cost_unit string, period_start timestamp_ntz, period_end timestamp_ntz, cost_details string, "
                              "created_at timestamp_ntz, updated_at timestamp_ntz", "", "calculation_id>calculations", cost_currency="USD"),
    "approvals": _table("id bigint, calculation_id bigint, request_status string, approved_by bigint, approval_date timestamp_ntz, rejection_reason string, "
                        "approver_comments string, requires_escalation boolean, created_at timestamp_ntz, updated_at timestamp_ntz",
                        "calculation_id", "calculation_id>calculations approved_by>users", request_status="pending", requires_escalation=False),
    "proofs": _table("id bigint, approval_id bigint, proof_content string, document_id bigint, proof_hash string, is_finalized boolean, "
                     "created_at timestamp_ntz, updated_at timestamp_ntz", "approval_id", "approval_id>approvals document_id>documents", is_finalized=True),
    "audit_logs": _table("id bigint, user_id bigint, action string, entity_type string, entity_id bigint, document_id bigint, query_id bigint, "
                         "calculation_id bigint, approval_id bigint, cost_breakdown_id bigint, proof_id bigint, action_details string, result_status string, "
                         "result_message string, timestamp timestamp_ntz", "",
                         "user_id>users document_id>documents query_id>queries calculation_id>calculations approval_id>approvals "
                         "cost_breakdown_id>cost_breakdowns proof_id>proofs"),
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the table's columns in their order and types.

    A column that is missing, or null where the table has a default, takes the
    default (null without one); a value that its type cannot hold becomes null;
    arrays, maps and structs become JSON texts; other columns are left out.
    """
    table = SYSTEM_TABLES[name]
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = []
    for column, kind in table.columns:
        default = F.lit(table.defaults.get(column)).cast(kind)
        if column not in have:
            out.append(default.alias(column))
            continue
        value = F.col(f"`{column}`")
        if kind == "string" and have[column].startswith(("array", "map", "struct")):
            value = F.to_json(value)
        elif have[column] != kind:
            value = value.try_cast(kind)
        out.append((F.coalesce(value, default) if column in table.defaults else value).alias(column))
    return df.select(*out)


#: Rows of a table that one task counts.
ROWS_PER_TASK = 1_000_000


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions, by id, as give a task about ``ROWS_PER_TASK`` rows; smaller tables as they are."""
    tasks = -(-df.count() // ROWS_PER_TASK)
    return df.repartition(tasks, "id") if tasks > max(1, df.rdd.getNumPartitions()) else df


def integrity(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, check, rows) of the conformed ``tables``, every check with its count.

    Checks: ``missing_key`` (null id), ``surplus_key`` and ``surplus_value`` (rows
    beyond the first of an id or unique value; nulls do not count), ``orphan``
    (values that refer to no row of a table that is given).
    """
    spark = next(iter(tables.values())).sparkSession
    checks, parts = [], []
    # hash tables over keys hold a task's rows: a task gets a bounded number of them, however large a file's splits are
    tables = {name: dealt(df.select("id", *dict.fromkeys(c for c in (*SYSTEM_TABLES[name].unique, *SYSTEM_TABLES[name].references) if c != "id")))
              for name, df in tables.items()}
    for name, df in tables.items():
        table = SYSTEM_TABLES[name]
        keys = ["id", *[u for u in table.unique if u != "id"]]
        checks += [(name, "id", "missing_key"), (name, "id", "surplus_key"), *[(name, u, "surplus_value") for u in keys[1:]]]
        cells = F.explode(F.array(*[F.struct(F.lit(k).alias("column_name"), distinct_key(F.col(k)).alias("v")) for k in keys]))
        counts = df.select(cells.alias("c")).select("c.*").groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
        found = counts.select("column_name", F.when(F.col("v").isNull(), F.when(F.col("column_name") == "id", "missing_key"))
                              .when(F.col("column_name") == "id", "surplus_key").otherwise("surplus_value").alias("check"),
                              F.when(F.col("v").isNull(), F.col("n")).otherwise(F.col("n") - 1).alias("rows"))
        parts.append(found.where("check is not null and rows > 0").select(F.lit(name).alias("table_name"), "column_name", "check", "rows"))
        for column, parent in table.references.items():
            if parent in tables:
                checks.append((name, column, "orphan"))
                known = tables[parent].select(F.col("id").alias("_id")).where("_id is not null").distinct()
                lost = df.select(F.col(column).alias("_v")).where("_v is not null").groupBy("_v").agg(F.count(F.lit(1)).alias("rows"))
                lost = lost.join(known, F.col("_v") == F.col("_id"), "left_anti")
                parts.append(lost.select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), F.lit("orphan").alias("check"), "rows"))
    every = spark.createDataFrame([(*c, 0) for c in checks], "table_name string, column_name string, check string, rows bigint")
    for p in parts:
        every = every.unionByName(p)
    return every.groupBy("table_name", "column_name", "check").agg(F.sum("rows").alias("rows"))
