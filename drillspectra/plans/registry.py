"""Named queries, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from .views import Views, with_views

_ENTRIES: dict[str, tuple[Callable[[Views], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views)``; ``sql`` may name any shared view."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in _ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        _ENTRIES[name] = (fn, sql)
        return fn

    return register


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Views(spark, sf_dir))

        return run

    return {name: bind(fn) for name, (fn, _) in _ENTRIES.items()}


def sql_texts() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in _ENTRIES.items() if sql is not None}
