"""Query registry: every query sits next to the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FIXTURE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` may use the fixture names, which become common table expressions."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in re.findall(r"\bfx_\w+", sql):
        if name in FIXTURE_SQL and name not in seen:
            _needed(FIXTURE_SQL[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def expand(sql: str) -> str:
    """Prefix the fixtures a statement mentions. A statement may bring its own `with` list."""
    ctes = [f"{name} as ({FIXTURE_SQL[name].strip()})" for name in _needed(sql, [])]
    body = sql.strip()
    recursive = ""
    own = re.match(r"with\s+(recursive\s+)?", body, re.IGNORECASE)
    if own:
        recursive = "recursive " if own.group(1) else ""
        body = body[own.end():]
        return f"with {recursive}" + ",\n".join([*ctes, body])
    return (f"with " + ",\n".join(ctes) + "\n" if ctes else "") + body


def oracle_statements() -> dict[str, str]:
    return {name: expand(sql) for name, sql in ORACLES.items()}
