"""Named queries: name -> callable(spark, sf_dir), and name -> equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL where SQL expresses it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def load() -> None:
    """Import the modules that register queries."""
    from provena.plans import close_queries, event_queries, link_queries, matching_queries, money_queries, search_queries, sink_queries, source_queries, state_queries, text_queries  # noqa: F401


def catalog() -> list[dict]:
    """The named queries as a callable surface: name, what it answers, and whether SQL says the same."""
    load()
    return [{"name": n, "answers": (q.__doc__ or "").strip().split("\n")[0], "has_sql": n in ORACLES} for n, q in sorted(QUERIES.items())]
