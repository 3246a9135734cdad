"""Where the plans register their queries: a callable and, where SQL can express it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = "") -> Callable[[Query], Query]:
    """Registers a query under the survey's id. `uses` names the adapter views that the oracle reads."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            from .sources.testdata import with_views

            ORACLES[name] = with_views(sql, uses.split())
        return f

    return add
