"""All queries of the library proper, by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketlens.plans import documents, mapping, statistics, studies, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _m in (statistics, mapping, documents, texts, studies):
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
