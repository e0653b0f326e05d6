"""Named queries: a Spark plan over one scale-factor folder and, where SQL can say it, a DuckDB oracle."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.sources.fixtures import Fixtures, duckdb_cte, fixtures

AS_OF = dt.date(2001, 7, 31)
AS_OF_SQL = "DATE '2001-07-31'"


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Fixtures], DataFrame]
    views: tuple[str, ...] = ()
    oracle_body: str | None = None
    doc: str = ""

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(fixtures(spark, sf_dir))

    def oracle(self) -> str | None:
        if self.oracle_body is None:
            return None
        return (duckdb_cte(self.views) if self.views else "") + self.oracle_body.strip()


REGISTRY: dict[str, Query] = {}


def register(name: str, views: tuple[str, ...] | list[str] = (), oracle: str | None = None):
    def deco(fn: Callable[[Fixtures], DataFrame]):
        prev = REGISTRY.get(name)
        if prev is not None and prev.build.__qualname__ != fn.__qualname__:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, tuple(views), oracle, (fn.__doc__ or "").strip())  # reload-safe
        return fn
    return deco
