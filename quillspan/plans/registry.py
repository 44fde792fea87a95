"""All queries of the core, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.plans import data_problems, dialect_queries, estate_queries, store_queries

MODULES = [data_problems, dialect_queries, store_queries, estate_queries]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect_queries.flagship(spark, sf_dir)
