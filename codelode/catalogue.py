"""All core queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import code, documents  # noqa: F401  (they register their queries)
from .plans.registry import QUERIES, SQL, Query


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: hybrid ranking of the files of one project."""
    return code.hybrid_search(spark, folder)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
