"""The registered queries: each module has QUERIES (name to function of session and data folder) and SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["snapshots", "texts", "evaluate", "diagnose", "corpora", "pages"]


def registered() -> tuple[dict, dict]:
    """(queries, SQL) of all modules; a name may stand in one module only."""
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        module = import_module(f"quern.queries.{name}")
        if twice := queries.keys() & module.QUERIES.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
