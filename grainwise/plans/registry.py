"""Query registry: each query is a Spark callable plus, where SQL can express it, a SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grainwise.plans.sqlviews import SQL_VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the derived views it mentions, as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for view, body in SQL_VIEWS.items():
            if view not in needed and re.search(rf"\b{view}\b", text):
                visit(body)
                if view not in needed:
                    needed.append(view)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS ({SQL_VIEWS[v].strip()})" for v in needed)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
