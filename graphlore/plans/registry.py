"""Where queries and the SQL they are held against are registered."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Callable], Callable]:
    """Register a query under its own or another name, with its SQL where there is one."""

    def add(run: Callable) -> Callable:
        QUERIES[name or run.__name__] = run
        if sql is not None:
            ORACLE_SQL[name or run.__name__] = sql
        return run

    return add
