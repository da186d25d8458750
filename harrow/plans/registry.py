"""Every query by name, and its SQL. The modules of this package add theirs with ``query``."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "page_report"
MODULES = ("urls", "pages", "changes", "knowledge", "jobs", "network", "social", "roundtrip", "documents", "evaluation", "streams")


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(f: Callable) -> Callable:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def names(values) -> str:
    """A list of strings for SQL's IN."""
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def doubles(sql: str, *columns: str) -> str:
    """``sql`` with decimal columns as doubles."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in columns)}) FROM ({sql})"


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"harrow.plans.{m}")
