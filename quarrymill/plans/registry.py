"""Every registered query of the library proper, with its checking SQL.

A plan module offers ``QUERIES``: name -> (function of (spark, directory), SQL or None).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@cache
def _all() -> dict[str, tuple[Query, str | None]]:
    from quarrymill.plans import bundles, chunks, discovery, documents, extract, facts, health, ladders, links, logs, relational, sections, sinks, streams, telemetry

    found: dict[str, tuple[Query, str | None]] = {}
    for module in (links, relational, telemetry, documents, discovery, facts, sections, bundles, health, logs, chunks, streams, sinks, extract, ladders):
        clash = found.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        found |= module.QUERIES
    return found


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
