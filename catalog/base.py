"""Registration and table access for the catalogue modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratacode.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries of one family and the SQL that states the same result."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def register(fn: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                prepare(spark)
                return fn(spark, sf_dir)

            self.queries[name] = run
            if sql is not None:
                self.oracle[name] = sql
            return fn

        return register


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table as it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
