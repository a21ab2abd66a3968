"""Value state: the last write per key (and namespace) wins; a delete hides it.

max_by combines map-side, so a hot key costs one row per task and no sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.plans.spec import StateSpec


def last_writes(ops: DataFrame, *by: str) -> DataFrame:
    """The newest operation per key, tombstones included."""
    by = by or ("key",)
    newest = F.max_by(F.struct("op", "value", "write_ms"), "seq").alias("w")
    return ops.groupBy(*by).agg(newest, F.max("seq").alias("seq")).select(*by, "w.op", "w.value", "seq", "w.write_ms")


def value_state(ops: DataFrame, *by: str) -> DataFrame:
    return last_writes(ops, *by).where(F.col("op") == "PUT").drop("op")


def contains(keys: DataFrame, state: DataFrame, *by: str) -> DataFrame:
    """keys with a boolean `present`."""
    by = list(by or ("key",))
    return keys.join(state.select(*by).distinct().withColumn("__hit", F.lit(True)), by, "left").withColumn("present", F.coalesce("__hit", F.lit(False))).drop("__hit")


def get_or_default(keys: DataFrame, state: DataFrame, default) -> DataFrame:
    return keys.join(state.select("key", "value"), "key", "left").withColumn("value", F.coalesce("value", F.lit(default)))


def multi_get(keys: DataFrame, state: DataFrame, *by: str) -> DataFrame:
    """Null keys are skipped, misses omitted."""
    by = list(by or ("key",))
    return state.join(keys.select(*by).dropna().distinct(), by, "left_semi")


def remove_all(state: DataFrame, keys: DataFrame, *by: str, spec: StateSpec | None = None) -> DataFrame:
    if spec:
        spec.require("remove_key")
    return state.join(keys.select(*by or ("key",)), list(by or ("key",)), "left_anti")


def put_all(ops: DataFrame, values: DataFrame) -> DataFrame:
    """ops followed by a PUT per row of values (key, value, seq, write_ms)."""
    return ops.unionByName(values.withColumn("op", F.lit("PUT")), allowMissingColumns=True)


def get_and_remove(ops: DataFrame, keys: DataFrame, seq: int) -> tuple[DataFrame, DataFrame]:
    """What the keys held, and the log after their removal at `seq`."""
    held = multi_get(keys, value_state(ops))
    gone = held.select("key", F.lit("DELETE").alias("op"), F.lit(seq).cast("long").alias("seq"))
    return held, ops.unionByName(gone, allowMissingColumns=True)


def namespaces_as_map(state: DataFrame, spec: StateSpec | None = None) -> DataFrame:
    """(key, entries map<ns, value>) of namespaced state; entries in namespace order."""
    if spec:
        spec.require("get_all_namespaces")
    return state.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ns", "value")))).alias("entries"))
