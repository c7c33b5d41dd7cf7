"""Imports every query module so the registry is populated."""

from covenant.plans import q_io, q_ledger, q_penalties, q_profile, q_rules, q_text  # noqa: F401
