"""The queries of the library by name, with the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ledger_queries, mechanism_queries, registry_queries, text_queries  # noqa: F401  they register themselves
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's yearly facts, from wide records by way of derived ratios."""
    return ledger_queries.prj8_mth1_facts(spark, sf_dir)
