"""All queries of the core, with the SQL that gives the same rows."""

from __future__ import annotations

from filings import registry
from filings.operators import audit, benchmark, changes, chunking, outputs, parsing, provenance, reconciliation, records, retrieval, risk, scoring, snapshots, units, xbrl  # noqa: F401

QUERIES = registry.QUERIES
SQL: dict[str, str] = registry.SQL

ELSEWHERE = {"S2": "filings.sources.fetch", "S13": "filings.sources.files", "V28": "filings.cli", "M9": "filings.operators.benchmark", "F3": "filings.operators.changes"}
