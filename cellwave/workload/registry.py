"""Query registry and the table reader the queries share."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellwave.functions.ship import ship_package

FAMILIES = (
    "manifest",
    "evaluation",
    "axes",
    "elementwise",
    "series",
    "spectral",
    "ingest",
    "adapters",
    "artifacts",
)
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """Parquet tables of one scale directory, by attribute."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        # event times are zone-less; a fixed zone keeps epoch seconds stable
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` and the SQL it must agree with."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            _SQL[name] = sql
        return fn

    return register


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"cellwave.workload.{family}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
