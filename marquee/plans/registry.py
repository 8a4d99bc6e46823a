"""Registered queries of the event-listing operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers the decorated (spark, sf_dir) -> DataFrame under name."""

    def add(f: Callable) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add
