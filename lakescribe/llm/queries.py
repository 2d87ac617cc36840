"""The registered queries of this subpackage and their SQL: name -> callable, name -> text."""

from __future__ import annotations

from importlib import import_module

from .shipping import shipping

MODULES = (
    "substring_query", "quality_query", "jaccard_query", "chat_query", "pii_query", "piece_query",
    "language_query", "line_query", "packing_query", "embedding_query",
    "byte_pair_query", "spelling_query", "hard_negative_query",
)


#: Imported with this module, so that a library that is missing shows where the optional part is imported.
_LOADED = [import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: shipping(f) for m in _LOADED for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _LOADED for k, s in m.ORACLES.items()}
