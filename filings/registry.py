
from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(ids: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        COVERS[f.__name__] = tuple(ids.split())
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
