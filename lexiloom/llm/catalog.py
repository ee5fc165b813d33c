"""All queries of this subpackage, with their SQL."""

from __future__ import annotations

from . import leak_queries, mixture_queries, neardup_queries, packing_queries, reading_queries, termfreq_queries, text_queries

_MODULES = (text_queries, neardup_queries, mixture_queries, termfreq_queries, packing_queries, leak_queries, reading_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.oracle_sql().items()}
