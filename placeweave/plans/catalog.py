"""Registered queries: one Spark job per operator group, each over whole
driver tables, with an equivalent DuckDB query where SQL can express it.

``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name]`` is the SQL
twin (tables are pre-registered as views).  Column names and types agree
between the two; lists are rendered as ``,``-joined strings.
"""

from __future__ import annotations

from placeweave.plans import q_captured, q_checks, q_extract, q_features, q_pages, q_rules, q_tables  # noqa: F401  (registration side effect)
from placeweave.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
