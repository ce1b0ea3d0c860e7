"""Registry of the runnable queries and their SQL twins, plus typed access to the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR_US = 3_600_000_000


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` states the same answer for DuckDB."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone is."""
    since = f"cast({column} as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00'"
    return F.expr(f"cast(cast({since} as decimal(20,6)) * 1000000 as bigint)")


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Events with ``ts_us``; only the named columns are read."""
    names = columns or ("event_id", "user_id", "event_type", "value")
    return table(spark, sf_dir, "events").select(*names, micros("ts").alias("ts_us"))
