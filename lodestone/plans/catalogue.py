"""The engine's query catalogue: every query by name, and DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from lodestone.plans import dialogue_queries, index_queries, learning_queries, text_queries, vector_queries

MODULES = [text_queries, vector_queries, dialogue_queries, index_queries, learning_queries]


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
