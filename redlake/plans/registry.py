"""Every query of the change-tracking engine by name, with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import aggregates, joins, scalars, sources, streams  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest that each recipient is still to get."""
    return QUERIES["change_digest"](spark, sf_dir)
