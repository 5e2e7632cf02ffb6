"""Every query of the package by name, and its SQL."""

from __future__ import annotations

from matchspark.plans import matching, postings, records, reports, runs, streams, texts

_MODULES = (matching, postings, texts, records, reports, runs, streams)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
