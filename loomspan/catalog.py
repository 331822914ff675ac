"""All queries over the driver's tables, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.queries import ORACLE_SQL, QUERIES, calls, contrasts, costs, intervals, reports, skills  # noqa: F401  (they register themselves)

__all__ = ["ORACLE_SQL", "QUERIES", "entry"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: errors on Mondays by tool, hour and weekday."""
    return calls.f14_filtered_distributions(spark, sf_dir)
