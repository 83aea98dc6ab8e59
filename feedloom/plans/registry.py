"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.sources.tables import TABLES, VIEWS, duckdb_text, needs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = with_views(sql)
        return function

    return add


def _views_of(names: set[str]) -> list[str]:
    """The named views and those they read, each after its sources."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        for source in needs(VIEWS[name]):
            visit(source)
        ordered.append(name)

    for name in sorted(names):
        visit(name)
    return ordered


def with_views(sql: str) -> str:
    """Prefix checking SQL with the views it reads."""
    used = {v for v in VIEWS if re.search(rf"\b{v}\b", sql)}
    body = sql.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    views = [f"{v} AS ({duckdb_text(v)})" for v in _views_of(used)]
    if not views:
        return body
    if own:
        return "WITH RECURSIVE " + ",\n".join(views) + ",\n" + body[own.end():]
    return "WITH RECURSIVE " + ",\n".join(views) + "\n" + body
