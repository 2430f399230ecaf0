"""Registered queries: a Spark plan, the SQL that gives the same rows, and the columns of both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Query] = {}
PLACES = 6


@dataclass(frozen=True)
class Query:
    plan: Callable[[SparkSession, str], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.plan(spark, sf_dir)
        return df.select(*[(F.round(F.col(c).cast(k), PLACES) + F.lit(0.0) if k == "double" else F.col(c).cast(k)).alias(c) for c, k in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(f"round(q.{c}::DOUBLE, {PLACES}) + 0.0 AS {c}" if k == "double" else f"q.{c}::{k if k != 'string' else 'VARCHAR'} AS {c}" for c, k in self.columns)
        return f"SELECT {cols} FROM ({self.sql}) q"


def query(columns: str, sql: str | None = None):
    """Register the decorated plan under its name; columns as 'name type, ...'."""

    def add(plan: Callable[[SparkSession, str], DataFrame]):
        QUERIES[plan.__name__] = Query(plan, tuple(tuple(c.split()) for c in columns.split(", ")), sql)
        return plan

    return add
