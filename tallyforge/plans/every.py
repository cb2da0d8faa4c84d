"""Importing this brings in all queries of the engine."""

from __future__ import annotations

from tallyforge.plans import eval_queries, evidence_queries, ledger_queries, letter_queries, queries, source_queries  # noqa: F401
