"""What a store's operators want to know: sizes, tombstones, space amplification, which ranges to compact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.operators import values


def log_statistics(ops: DataFrame, group) -> DataFrame:
    """Per key group: operations, tombstones, distinct keys, live keys and operations per live key."""
    counted = ops.groupBy(group.alias("kg"), "key").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("op") == "DELETE", 1)).alias("d"), F.max_by("op", "seq").alias("last")
    )
    return counted.groupBy("kg").agg(
        F.sum("n").alias("ops"), F.sum("d").alias("tombstones"), F.count(F.lit(1)).alias("keys"),
        F.count(F.when(F.col("last") != "DELETE", 1)).alias("live"),
    ).withColumn("amplification", F.when(F.col("live") > 0, F.col("ops").cast("double") / F.col("live")))


def compaction_candidates(statistics: DataFrame, limit: float) -> DataFrame:
    """Key groups whose amplification exceeds the limit, or that hold tombstones only."""
    return statistics.where((F.col("amplification") > limit) | F.col("amplification").isNull())


def coldest_first(ops: DataFrame, group) -> DataFrame:
    """Key groups by last write: the order in which a store would move them out of memory."""
    return ops.groupBy(group.alias("kg")).agg(F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("ops"))


def tombstones(ops: DataFrame, *by: str) -> DataFrame:
    return values.last_writes(ops, *by).where(F.col("op") == "DELETE")
