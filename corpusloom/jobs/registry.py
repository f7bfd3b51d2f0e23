"""Every query by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.jobs import evaluation, replies, reports, research, retrieval, telemetry, validation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = retrieval.QUERIES | evaluation.QUERIES | replies.QUERIES | validation.QUERIES | reports.QUERIES | research.QUERIES | telemetry.QUERIES
ORACLE_SQL: dict[str, str] = retrieval.ORACLE_SQL | evaluation.ORACLE_SQL | replies.ORACLE_SQL | validation.ORACLE_SQL | reports.ORACLE_SQL | research.ORACLE_SQL | telemetry.ORACLE_SQL
