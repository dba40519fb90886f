"""All registered queries of the engine and their independent SQL."""

from __future__ import annotations

from . import article_queries, corpus_queries, layout_queries, page_queries, text_queries, view_queries

MODULES = (text_queries, corpus_queries, layout_queries, article_queries, view_queries, page_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
