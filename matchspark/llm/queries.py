"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from matchspark.llm import ann, byte_bpe, chat_format, language_id, license_scan, near_dedup, packing, periodic_runs, quality, simhash, substring_dedup, toxicity, whitening

MODULES = [ann, byte_bpe, chat_format, language_id, license_scan, near_dedup, packing, periodic_runs, quality, simhash, substring_dedup, toxicity, whitening]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
