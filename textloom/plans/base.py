"""Registration of queries and the shared views, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the named ``views``."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql, *views)
        return f

    return add


def with_views(sql: str, *views: str) -> str:
    from textloom.sources.views import SQL

    needed: list[str] = []

    def need(v: str) -> None:
        if v not in needed:
            for w in SQL:
                if w != v and w in SQL[v]:
                    need(w)
            needed.append(v)

    for v in views:
        need(v)
    if not needed:
        return sql
    parts = ", ".join(f"{v} AS ({SQL[v]})" for v in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {parts}, {body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {parts}, {body[5:].strip()}"
    return f"WITH {parts} {body}"
