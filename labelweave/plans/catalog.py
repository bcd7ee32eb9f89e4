"""Registered queries: each is a Spark plan over the driver tables plus
(where SQL can express it) the equivalent DuckDB oracle.

Queries are grouped by module; importing ``labelweave.plans.queries``
registers all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from labelweave.session import configure


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, run, sql, (fn.__doc__ or "").strip())
        return run
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import labelweave.plans.queries  # noqa: F401  (registers)
    return {k: q.fn for k, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    import labelweave.plans.queries  # noqa: F401
    return {k: q.sql for k, q in REGISTRY.items() if q.sql}
