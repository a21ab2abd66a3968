"""Snapshots as cuts of the log, items, restore, rescale, migration, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.functions import keygroups
from foldstone.operators import values
from foldstone.plans.spec import StateSpec


def at(ops: DataFrame, seq) -> DataFrame:
    """The log as of a sequence number: folding it gives the state that a checkpoint there holds."""
    return ops.where(F.col("seq") <= seq)


def increment(ops: DataFrame, previous, current) -> DataFrame:
    """What an incremental snapshot adds to the one at `previous`."""
    return ops.where((F.col("seq") > previous) & (F.col("seq") <= current))


def items(state: DataFrame, spec: StateSpec, group: Column) -> DataFrame:
    """Canonical export rows; tombstones have been folded away. Values become JSON where they are nested.

    A timer's value is its time. write_ms is the state's write time where it has one, of a list its last element's.
    """
    columns = set(state.columns)
    text = lambda name: F.col(name).cast("string") if name in columns else F.lit(None).cast("string")
    value = F.to_json("elements") if "elements" in columns else F.to_json("entries") if "entries" in columns else text("ts_ms") if spec.kind == "PQ" else text("value")
    written = F.col("write_ms").cast("long") if "write_ms" in columns else F.lit(None).cast("long")
    return state.select(
        F.lit(spec.kind).alias("state_type"), F.lit(spec.name).alias("state_name"), group.cast("int").alias("key_group"),
        F.col("key").alias("key"), text("ns").alias("ns"), text("subkey").alias("map_key"), value.alias("value"), written.alias("write_ms"),
    )


def savepoint(*states: DataFrame) -> DataFrame:
    """Items of all states, non-decreasing by key group."""
    whole = states[0]
    for state in states[1:]:
        whole = whole.unionByName(state)
    return whole.orderBy("key_group", "state_type", "state_name", "key", "ns", "map_key")


def as_ops(restored: DataFrame, value_type: str) -> DataFrame:
    """Value and map items, namespaced or not, as PUTs at sequence 0 with their write time, older than any write that follows."""
    rows = restored.where(F.col("state_type").isin("VALUE", "SUB_VALUE", "MAP", "SUB_MAP"))
    return rows.select("key", "ns", F.col("map_key").alias("subkey"), F.lit("PUT").alias("op"), F.col("value").cast(value_type).alias("value"), F.lit(0).cast("long").alias("seq"), "write_ms")


def as_list_ops(restored: DataFrame, element_type: str) -> DataFrame:
    """List items, namespaced or not: one PUT per element, in place, at sequence 0."""
    rows = restored.where(F.col("state_type").isin("LIST", "SUB_LIST"))
    return rows.select("key", "ns", F.lit("PUT").alias("op"), F.lit(0).cast("long").alias("seq"), "write_ms", F.posexplode(F.from_json("value", f"array<{element_type}>")).alias("pos", "value"))


def as_timer_ops(restored: DataFrame) -> DataFrame:
    """Timer items as ADDs at sequence 0."""
    return restored.where(F.col("state_type") == "PQ").select("key", F.col("value").cast("long").alias("ts_ms"), F.lit("ADD").alias("op"), F.lit(0).cast("long").alias("seq"))


def restore_from(kind: str | None, snapshots: list[DataFrame], later: DataFrame, value_type: str = "double") -> DataFrame:
    """ops to fold: nothing restored, increments (ops), or a savepoint (value and map items); other kinds are refused."""
    if kind is None:
        return later
    if kind == "incremental":
        return restore(snapshots, later)
    if kind == "savepoint":
        return restore([as_ops(s, value_type).select(*later.columns) for s in snapshots], later)
    raise ValueError(f"cannot restore from {kind}")


def restore(snapshots: list[DataFrame], later: DataFrame) -> DataFrame:
    """Several snapshots (ops with their sequence numbers) and the writes after them.

    Later writes are moved above every restored sequence number, so they win.
    """
    restored = snapshots[0]
    for snapshot in snapshots[1:]:
        restored = restored.unionByName(snapshot)
    top = restored.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top"))
    lifted = later.crossJoin(F.broadcast(top)).withColumn("seq", F.col("seq") + F.col("top") + 1).drop("top")  # one row
    return restored.unionByName(lifted)


def of_subtask(state: DataFrame, group: Column, i: int, m: int, p: int) -> DataFrame:
    """Rows whose key group subtask i of p owns."""
    first, last = -(-i * m // p), -(-(i + 1) * m // p) - 1
    return state.where(group.between(first, last))


def rescale_plan(tasks_from: DataFrame, tasks_to: DataFrame) -> DataFrame:
    """Overlaps of old and new ranges: (old, new, lo, hi, clipped). Inputs: (task, lo, hi), one row per subtask.

    A range-overlap join of two tables bounded by the maximum parallelism; each range is first expanded to the
    key groups that it starts in, so that it is an equi-join.
    """
    each = lambda t, name: t.select(F.col("task").alias(name), F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi"), F.explode(F.sequence("lo", "hi")).alias("g"))
    met = each(tasks_from, "old").join(each(tasks_to, "new"), "g")
    spans = met.groupBy("old", "new", "old_lo", "old_hi").agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
    return spans.withColumn("clipped", (F.col("lo") > F.col("old_lo")) | (F.col("hi") < F.col("old_hi"))).drop("old_lo", "old_hi")


def migrate(state: DataFrame, old: StateSpec, new: StateSpec) -> DataFrame:
    """Every value cast to the new declaration; refused changes raise."""
    old.check(new)
    return state.withColumn("value", F.col("value").cast(new.value))


def compact(ops: DataFrame, full: bool, *by: str) -> DataFrame:
    """The log with one operation per key. Tombstones go only when no older log can hold the key."""
    folded = values.last_writes(ops, *by)
    return folded.where(F.col("op") != "DELETE") if full else folded


def compact_lists(ops: DataFrame, full: bool) -> DataFrame:
    """List logs keep what is behind the last reset; without full, a reset by DELETE stays as a tombstone."""
    resets = ops.where(F.col("op").isin("PUT", "DELETE")).groupBy("key").agg(F.max("seq").alias("reset_seq"))
    kept = ops.join(resets, "key", "left").where(F.col("reset_seq").isNull() | (F.col("seq") >= F.col("reset_seq"))).drop("reset_seq")
    return kept.where(F.col("op") != "DELETE") if full else kept


def separate(state: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(key, inline value or null, blob_id or null) and the blobs (blob_id, value) larger than threshold bytes."""
    large = F.octet_length("value") > threshold
    split = state.withColumn("blob_id", F.when(large, F.col("seq")))
    return split.withColumn("value", F.when(~large, F.col("value"))), split.where(large).select("blob_id", "value")


def collect_blobs(blobs: DataFrame, state: DataFrame) -> DataFrame:
    """Blobs that some state row still points at."""
    return blobs.join(state.select("blob_id").where(F.col("blob_id").isNotNull()).distinct(), "blob_id", "left_semi")


def groups_of(state: DataFrame, m: int) -> DataFrame:
    return state.withColumn("key_group", keygroups.key_group(keygroups.raw_hash(F.col("key")), m).cast("int"))
