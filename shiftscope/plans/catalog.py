"""All registered queries of the upgrade-impact operators, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import driver, oracles
from .driver import Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts write the names in use, and what is left unattributed."""
    return driver.match_buckets(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(driver.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
