"""Collects (query, oracle SQL) pairs under their registered names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator; `sql` is the DuckDB text that gives the same rows, if SQL can."""

        def put(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a catalog of named things: n_nationkey, n_name."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS n_nationkey", "c_name AS n_name")


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as another: r_regionkey, r_name."""
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS r_regionkey", "s_name AS r_name")
