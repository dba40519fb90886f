"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

import importlib

MODULES = ("ngram_join", "url_filter", "vector_dedup", "exact_dedup", "sharding", "warc", "token_counts", "bpe", "mixing", "toxicity")


def _gather(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{m}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
