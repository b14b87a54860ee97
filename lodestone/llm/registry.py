"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, conversation_repair, decontaminate, exact_dedup, html_text, jaccard_join, language_id, periodic_runs, source_mix, substring_dedup, token_shards, toxicity, warc_fixity

MODULES = (jaccard_join, substring_dedup, html_text, bpe, decontaminate, warc_fixity, toxicity, token_shards, language_id, exact_dedup, source_mix, periodic_runs, conversation_repair)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
