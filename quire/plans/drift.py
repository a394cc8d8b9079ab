"""Queries over schemas that drift between files (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.operators import schema_drift
from quire.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.top_level(schema_drift.changes(table(spark, sf_dir, "scope_audit_line")))


def p3_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.changes(table(spark, sf_dir, "scope_audit_line"))


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.unified(table(spark, sf_dir, "scope_audit_line"))


QUERIES = {"p3_found": p3_found, "p3_changes": p3_changes, "p3_unified": p3_unified}
SQL: dict[str, str] = {}
