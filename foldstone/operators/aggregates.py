"""Reducing and aggregating state, and merging namespaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.plans.spec import StateSpec


def reduce(rows: DataFrame, function: Column, *by: str) -> DataFrame:
    """An associative and commutative reduce, as a built-in aggregate: combined before the shuffle."""
    return rows.groupBy(*by or ("key",)).agg(function.alias("value"))


def reduce_in_order(rows: DataFrame, function: Callable[[Column, Column], Column], *by: str) -> DataFrame:
    """Any reduce: the first value as it is, then function(old, new) by sequence. The values of a key meet in one row."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda e: e["value"])
    folded = F.aggregate(F.slice("values", 2, F.greatest(F.size("values"), F.lit(1))), F.get("values", F.lit(0)), function)
    return rows.groupBy(*by or ("key",)).agg(values.alias("values")).withColumn("value", folded).drop("values")


def accumulate(rows: DataFrame, accumulator: dict[str, Column], *by: str) -> DataFrame:
    """Accumulator columns per key: the partial that a later merge folds on."""
    return rows.groupBy(*by or ("key",)).agg(*[c.alias(n) for n, c in accumulator.items()])


def merge_namespaces(state: DataFrame, target: Column, merge: dict[str, Column], spec: StateSpec | None = None) -> DataFrame:
    """Accumulators of all namespaces with the same target, merged into it; refused for state without namespaces.

    No sources is a no-op, absent ones are skipped, an absent target takes the merged value as it is.
    """
    if spec:
        spec.require("merge_namespaces")
    moved = state.withColumn("ns", target).where(F.col("ns").isNotNull())
    return moved.groupBy("key", "ns").agg(*[c.alias(n) for n, c in merge.items()])


def merge_lists(state: DataFrame, target: Column) -> DataFrame:
    """(key, ns, elements): lists of the sources behind each other, in namespace order."""
    moved = state.withColumn("target", target)
    ordered = F.array_sort(F.collect_list(F.struct("ns", "elements")))
    return moved.groupBy("key", "target").agg(F.flatten(F.transform(ordered, lambda e: e["elements"])).alias("elements")).withColumnRenamed("target", "ns")
