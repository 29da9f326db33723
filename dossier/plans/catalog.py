"""Registry of the ready-made queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(*covers: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a builder under its name with the survey rows it covers and its SQL."""

    def register(build: Build) -> Build:
        QUERIES[build.__name__] = Query(build.__name__, build, sql, covers)
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Build]:
    return {name: q.build for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql is not None}
