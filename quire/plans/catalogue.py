"""All queries of the core by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import dirty_rows, drift, extracts, relational, reviewing, texts

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "review_breadth"
MODULES = (drift, dirty_rows, reviewing, relational, texts, extracts)
QUERIES: dict[str, Query] = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL: dict[str, str] = {name: sql for module in MODULES for name, sql in module.SQL.items()}
