"""Registered queries, each with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFunction = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFunction
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a query under ``name``, with its equivalent SQL when there is one."""

    def add(function: QueryFunction) -> QueryFunction:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(function, sql)
        return function

    return add


def load() -> dict[str, Query]:
    """All registered queries (imports the modules that register them)."""
    from probcast.catalog import (  # noqa: F401
        forecasters, questions, reports, resolution, sampling, scoring, series, tables,
    )

    return REGISTRY
