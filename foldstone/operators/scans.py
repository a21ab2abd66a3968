"""Scans over whole states. Key scans return a key once, whatever number of entries it has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keys(state: DataFrame) -> DataFrame:
    return state.select("key").distinct()


def keys_in_namespace(state: DataFrame, namespace) -> DataFrame:
    return state.where(F.col("ns") == namespace).select("key").distinct()


def prefix(live: DataFrame, key) -> DataFrame:
    """All entries of one key. The filter on key reaches the scan of the log."""
    return live.where(F.col("key") == key)


def key_range(state: DataFrame, first, last) -> DataFrame:
    return state.where(F.col("key").between(first, last))


def keys_and_namespaces(state: DataFrame) -> DataFrame:
    return state.select("key", "ns").distinct()


def entry_count(state: DataFrame) -> DataFrame:
    return state.agg(F.count(F.lit(1)).alias("n"))
