"""The two registries and the decorator that fills them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.lens import Lens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Lens], DataFrame]], Callable[[Lens], DataFrame]]:
    """Register a function over a Lens under its own name, with its SQL if there is any."""

    def register(f: Callable[[Lens], DataFrame]) -> Callable[[Lens], DataFrame]:
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, folder: f(Lens(spark, folder))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register
