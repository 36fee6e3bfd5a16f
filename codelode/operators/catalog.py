"""Catalogue of projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(projects: DataFrame, name: str) -> DataFrame:
    """(project_id, way) of the project with that root, slug or id, in that order; empty if there is none."""
    way = F.when(F.col("project_root") == name, 0).when(F.col("slug") == name, 1).when(F.col("project_id") == name, 2)
    return projects.select("project_id", way.alias("way")).where("way is not null").orderBy("way", "project_id").limit(1)


def latest(projects: DataFrame) -> DataFrame:
    """S21."""
    return projects.orderBy(F.desc_nulls_last("indexed_at"), "project_id").limit(1)


def without(projects: DataFrame, name: str) -> DataFrame:
    """The catalogue without the project of that name; sources are never touched."""
    return projects.join(resolve(projects, name), "project_id", "left_anti")
