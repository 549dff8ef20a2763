"""The registered queries, each with its SQL form where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import entries, graph, incremental, index, search, streams, tracing, vault

_PARTS = (incremental, search, entries, graph, index, streams, tracing, vault)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}


FLAGSHIP = "bm25_top5"
