"""The queries of the engine over the driver's tables, each next to the SQL that gives the same rows.

A query is a function of Views. Its oracle names the views, so that both sides read one graph; queries without one use Python (a
similarity, a draw) or write files, and have tests against small references.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, oracle

_REGISTERED: dict[str, tuple[Callable[[Views], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with an oracle body."""

    def add(f):
        _REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def _load() -> None:
    from . import batch_queries, graph_queries, intake_queries, listing_queries, matching_queries, merging_queries, paged_queries, record_queries, review_queries, scale_queries, scalar_queries, snapshot_queries, source_queries, trade_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, (f, _) in _REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: oracle(sql) for name, (_, sql) in _REGISTERED.items() if sql}
