"""Registration of a query together with its check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fleetlens.queries.check_sql import with_parts

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, *parts: str) -> Callable[[Run], Run]:
    """Register a query; ``sql`` reads the named parts of ``check_sql``."""

    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = Query(run, None if sql is None else with_parts(sql, *parts))
        return run

    return register
