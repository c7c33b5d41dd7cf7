"""covenant: contract-compliance analytics on Spark DataFrames.

Checks operational tables against contract terms: type coercion, profiling,
data-quality checks, rule-driven penalties, cost roll-ups, audit/proof ledgers
and batch handling of documents, prompts, responses and SQL text.
"""

__version__ = "0.1.0"
