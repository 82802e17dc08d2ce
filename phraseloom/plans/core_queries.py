"""Registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phraseloom.plans import decode_queries, file_queries, lexicon_queries, mwe_queries, nested_queries, pipeline_queries, text_queries

_MODULES = (nested_queries, text_queries, lexicon_queries, mwe_queries, decode_queries, pipeline_queries, file_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
