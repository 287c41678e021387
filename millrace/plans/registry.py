"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cases, extras, followups, operators, relational, streams

MODULES: list = [operators, relational, extras, followups, cases, streams]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["entity_type_counts"](spark, sf_dir)


def queries() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= module.ORACLE
    return found
