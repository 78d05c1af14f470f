"""Registry that ties a Spark query to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    rows: str
    fn: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(rows: str, sql: str | None = None, name: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its own name, with its survey rows and checking SQL."""

    def wrap(fn: QueryFn) -> QueryFn:
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key} registered twice")
        REGISTRY[key] = Query(key, rows, fn, sql)
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a small input enough partitions for the cores at hand.

    A large table already arrives in more splits than there are cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
