"""How queries are named, run and checked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from redlake.sources.fixtures import fixture, oracle_ctes
from redlake.sources.tables import scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The tables of a folder, and the relations derived from them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return scan(self.spark, self.sf_dir, name)

    def __getattr__(self, name: str) -> DataFrame:
        return fixture(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, *fixtures: str):
    """Register a function of Inputs as a query; sql, after the fixtures' CTEs, checks it (`, x AS (...) SELECT` or `SELECT`)."""

    def wrap(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql:
            ORACLES[name] = f"{oracle_ctes(*fixtures)} {sql}"
        return f

    return wrap
