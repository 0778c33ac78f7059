"""All core queries and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("kv_queries", "store_queries", "rule_queries", "path_queries", "problem_queries")


def _loaded() -> list:
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: v for m in _loaded() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _loaded() for k, v in m.SQL.items()}
