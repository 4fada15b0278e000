"""All registered queries of the review engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir) -> DataFrame`` under a name, with the SQL it must agree with."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def load() -> None:
    """Import every module that registers queries."""
    from murmurate.operators import captures, changes, evaluate, exports, keeping, labels, prepared, rollups, rows, sampling, sets, shards, texts, upkeep, vectors  # noqa: F401
    from murmurate.streaming import sweeps  # noqa: F401
