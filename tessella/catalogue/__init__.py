"""Registered queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from tessella.catalogue import chunk_q, corpus_q, dataset_q, index_q, log_q, more_q, retrieval_q, rules_q, store_q, stream_q, text_q, verify_q

MODULES = (corpus_q, text_q, retrieval_q, store_q, verify_q, log_q, chunk_q, stream_q, more_q, rules_q, index_q, dataset_q)


def queries() -> dict:
    return {name: run for m in MODULES for name, run in m.query.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.query.SQL.items()}
