"""All queries by name, with the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name; ``sql`` is the DuckDB form of its result."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


for _part in ("ranking_plans", "analytics_plans", "join_plans", "text_plans", "section_plans", "matching_plans", "insight_plans", "requirement_plans", "component_plans", "verdict_plans", "document_plans", "record_plans", "vendor_plans", "dictionary_plans", "store_plans", "streaming_plans"):
    importlib.import_module(f"ranksmith.plans.{_part}")
