"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from .fixtures import SQL_VIEWS

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, with_: str = ""):
    """Register a query; ``with_`` holds further CTEs, ``sql`` the final SELECT."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            extra = f",\n{with_.strip()}" if with_.strip() else ""
            ORACLES[name] = f"WITH {SQL_VIEWS.strip()}{extra}\n{sql.strip()}"
        return fn

    return add
