"""Timers: a set of (timestamp, key) per key group, read in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Widths of the ranges inside which one task numbers timers, in time and in sequence numbers.
RANGE_MS, SEQS = 86_400_000, 1 << 16


def pending(ops: DataFrame, group: Column) -> DataFrame:
    """(kg, ts_ms, key): added and not removed since. Adding twice counts once, removing an absent one does nothing."""
    newest = ops.groupBy("key", "ts_ms").agg(F.max_by("op", "seq").alias("op"))
    return newest.where(F.col("op") == "ADD").select(group.alias("kg"), "ts_ms", "key")


def ordered(timers: DataFrame) -> DataFrame:
    """By key group, then time, then key: a range exchange, no single task."""
    return timers.orderBy("kg", "ts_ms", "key")


def peek(timers: DataFrame) -> DataFrame:
    """The first timer of each key group; the minimum combines before the shuffle."""
    return timers.groupBy("kg").agg(F.min(F.struct("ts_ms", "key")).alias("head")).select("kg", "head.ts_ms", "head.key")


def poll(timers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first timer of each key group, and the rest."""
    heads = peek(timers)
    return heads, timers.join(heads, ["kg", "ts_ms", "key"], "left_anti")


def placed(timers: DataFrame, range_ms: int = RANGE_MS) -> DataFrame:
    """timers with their place in their group's firing order.

    Timers are numbered inside ranges of time, and the ranges of a group by running counts: a group with most of the
    timers is spread over tasks.
    """
    ranged = timers.withColumn("__range", F.floor(F.col("ts_ms") / range_ms))
    counts = ranged.groupBy("kg", "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("kg").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("kg", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("kg", "__range").orderBy("ts_ms", "key")
    return ranged.withColumn("place", F.row_number().over(inside)).join(first, ["kg", "__range"]).withColumn("place", F.col("place") + F.col("__first")).drop("__range", "__first")


def due(timers: DataFrame, watermark_ms: Column) -> DataFrame:
    """Timers at or before the watermark with their place in their group's firing order."""
    return placed(timers.where(F.col("ts_ms") <= watermark_ms))


def add_all(ops: DataFrame, timers: DataFrame, seq: int) -> DataFrame:
    """ops followed by adding every row of timers (key, ts_ms)."""
    return ops.unionByName(timers.select("key", "ts_ms", F.lit("ADD").alias("op"), F.lit(seq).cast("long").alias("seq")), allowMissingColumns=True)


def is_empty(groups: DataFrame, timers: DataFrame) -> DataFrame:
    """(kg, empty) for the key groups asked for."""
    held = sizes(timers).select("kg", F.lit(True).alias("__held"))
    return groups.select("kg").distinct().join(held, "kg", "left").select("kg", F.col("__held").isNull().alias("empty"))


def sizes(timers: DataFrame) -> DataFrame:
    return timers.groupBy("kg").agg(F.count(F.lit(1)).alias("n"))


def head_changes(ops: DataFrame, group: Column) -> DataFrame:
    """ops of adds with head_changed: whether the timer became the first of its group among the adds before it."""
    now = F.struct("ts_ms", "key")
    adds = ops.where(F.col("op") == "ADD").withColumn("kg", group).withColumn("__range", F.floor(F.col("seq") / SEQS))
    heads = adds.groupBy("kg", "__range").agg(F.min(now).alias("__least"))
    ranges = Window.partitionBy("kg").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("kg", "__range", F.min("__least").over(ranges).alias("__before"))
    inside = Window.partitionBy("kg", "__range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    head = F.least("__before", "__inside")  # nulls are skipped
    found = adds.withColumn("__inside", F.min(now).over(inside)).join(heads, ["kg", "__range"]).withColumn("__head", head)
    return found.withColumn("head_changed", F.col("__head").isNull() | (now < F.col("__head"))).drop("__range", "__before", "__inside", "__head")
