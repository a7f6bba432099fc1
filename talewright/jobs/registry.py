"""Every query of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audit_queries, desc_queries, people_queries, project_queries, shot_queries, source_queries, text_queries  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each manuscript's storyboard runs, and in how many units."""
    return project_queries.u2(spark, sf_dir)
