"""All queries of the library, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import checked, documents, golden, knowledge, logs, records, stated, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**golden.QUERIES, **documents.QUERIES, **logs.QUERIES, **knowledge.QUERIES, **stated.QUERIES, **store.QUERIES, **checked.QUERIES, **records.QUERIES}
ORACLE_SQL: dict[str, str] = {**golden.ORACLE_SQL, **documents.ORACLE_SQL, **logs.ORACLE_SQL, **knowledge.ORACLE_SQL, **stated.ORACLE_SQL, **store.ORACLE_SQL, **checked.ORACLE_SQL, **records.ORACLE_SQL}
