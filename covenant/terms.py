"""Contract terms used by the registered queries.

FIXED VALUES — these restate the sample contract and the declared response
shapes; results must match them exactly, so they are kept here, plainly and in
the contract's own order.
"""

from __future__ import annotations

# --- FIXED VALUES: sample SLA contract ---------------------------------------
MONTHLY_SERVICE_FEE = 10000.0          # contract §3.3
MAX_MONTHLY_PENALTY_PCT = 30.0         # contract §3.3, cap on monthly credits
UPTIME_TARGET = 99.0                   # contract §2.1
RESPONSE_TARGET_SECONDS = 2.0          # contract §2.2

# Uptime credit tiers, (upper bound exclusive "<", percent of fee, amount)
UPTIME_TIERS = [
    (99.0, 5.0, 500.0),
    (98.9, 10.0, 1000.0),
    (98.0, 15.0, 1500.0),
    (95.0, 25.0, 2500.0),
]
# Response-time tiers, (lower bound exclusive ">", percent of fee, amount)
RESPONSE_TIERS = [
    (2.0, 2.0, 200.0),
    (5.0, 5.0, 500.0),
    (10.0, 10.0, 1000.0),
]
# Proportional forms: (100 - uptime) * 100 below 99; (rt - 2) * 50 above 2
UPTIME_PROPORTIONAL_RATE = 100.0
RESPONSE_PROPORTIONAL_RATE = 50.0

# Monthly allowance of replication-lag breaches before a breach counts
MONTHLY_BREACH_ALLOWANCE = 2

# Hours of notice from which maintenance excludes an incident (contract §5.2)
EXCLUSION_NOTICE_HOURS = {"scheduled": 48, "emergency": 24}

# Per-severity response / resolution limits in minutes: the library's own
# defaults, not fixed by any contract
SEVERITY_LIMITS = [
    # severity, initial response limit, resolution limit
    ("critical", 5, 120),
    ("high", 15, 240),
    ("medium", 30, 300),
    ("low", 60, 480),
]

# Limits that a service has of its own (None: any service, any severity, no such limit): likewise the library's defaults
SERVICE_LIMITS = [
    # service, severity, initial response limit, resolution limit
    ("error", "critical", 3, 90),
    ("purchase", "high", 10, None),
    ("view", None, None, 400),
    (None, None, 60, 480),
]

# --- FIXED VALUES: boolean words accepted by the coercion gate -------------
BOOLEAN_WORDS = ["true", "false", "1", "0", "yes", "no", "t", "f", "y", "n"]
TRUE_WORDS = ["true", "1", "yes", "y", "t"]
NULL_WORDS = ["null", "none", "na", "n/a", ""]

# --- FIXED VALUES: cost types and the column-name words that detect them ----
COST_TYPES = ["monetary", "credits", "units", "hours", "percentage", "custom"]
COST_COMMON_WORDS = [
    ("monetary", ["cost", "amount", "price", "fee", "charge", "penalty"]),
    ("credits", ["credit", "adjustment", "discount"]),
    ("hours", ["hours", "duration", "time"]),
]

# --- FIXED VALUES: SQL words ignored by the identifier lints ----------------
LINT_KEYWORDS_WORDS = [
    "SELECT", "FROM", "WHERE", "ORDER", "BY", "GROUP", "HAVING",
    "AS", "AND", "OR", "NOT", "IN", "CASE", "WHEN", "THEN", "ELSE", "END",
    "SUM", "AVG", "COUNT", "MAX", "MIN", "ROUND", "CAST", "INTERVAL",
    "DATE", "DATE_TRUNC", "CURRENT_DATE", "BETWEEN", "LIKE", "IS", "NULL",
    "TRUE", "FALSE", "DISTINCT", "JOIN", "ON", "LEFT", "RIGHT", "INNER", "OUTER",
    "LIMIT", "OFFSET", "ASC", "DESC", "EXTRACT", "YEAR", "MONTH", "DAY",
]
LINT_KEYWORDS_POSITION = [
    "SELECT", "FROM", "WHERE", "ORDER", "BY", "GROUP", "HAVING",
    "AS", "AND", "OR", "NOT", "IN", "CASE", "WHEN", "THEN", "ELSE", "END",
    "SUM", "AVG", "COUNT", "MAX", "MIN", "ROUND", "CAST", "INTERVAL",
    "DATE", "DATE_TRUNC", "CURRENT_DATE", "BETWEEN", "LIKE",
]
LINT_WORD_PATTERN = r"\b([a-zA-Z_][a-zA-Z0-9_]*)\b"
LINT_POSITION_PATTERN = r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:,|FROM|WHERE|ORDER|GROUP|HAVING|$|=|<|>|\))"

# --- FIXED VALUES: document types and the keys each must return -------------
DOCUMENT_TYPES = [
    # name, description, expected output keys
    ("custom", "Generic document type for any contractual or business document",
     ["document_summary", "parties_involved", "key_terms", "penalties_and_incentives",
      "data_requirements", "recommended_sql_approach"]),
    ("sla", "Service Level Agreement (SLA) contract - SLA Recovery Agent",
     ["sla_rules", "violation_conditions", "sql_query", "data_fields_required"]),
    ("insurance", "Insurance policy or claims document",
     ["policy_info", "claim_terms", "financial_terms", "data_requirements"]),
    ("service_agreement", "General service agreement or contract",
     ["agreement_overview", "financial_terms", "service_level_targets",
      "remedies_and_escalation"]),
]
GENERIC_TYPE = "custom"

# Response-cache key separator: sha256(system || "||" || prompt)
RESPONSE_PREVIEW_CHARS = 200
PROMPT_KEY_SEPARATOR = "||"
# Proof id: first 16 hex characters of sha256(approval id || ISO time)
PROOF_ID_HEX_CHARS = 16
RESULT_SAMPLE_LIMIT = 1000
