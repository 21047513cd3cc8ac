"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query, and DuckDB SQL with the same result where there is some."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


from strandlab.plans import columns, distances, groups, kernels_queries, reads, sweeps  # noqa: E402, F401
