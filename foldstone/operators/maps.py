"""Map state: the last write per (key, subkey) wins; a clear hides all older entries of its key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.operators.values import last_writes


def entries(ops: DataFrame, *by: str) -> DataFrame:
    """(key, subkey, value, seq, write_ms) of live entries. A DELETE without subkey clears its key."""
    by = list(by or ("key",))
    clears = ops.where((F.col("op") == "DELETE") & F.col("subkey").isNull()).groupBy(*by).agg(F.max("seq").alias("cleared"))
    newest = last_writes(ops.where(F.col("subkey").isNotNull()), *by, "subkey").where(F.col("op") == "PUT").drop("op")
    return newest.join(clears, by, "left").where(F.col("cleared").isNull() | (F.col("seq") > F.col("cleared"))).drop("cleared")


def whole_maps(live: DataFrame, *by: str) -> DataFrame:
    """(key, entries map); keys without live entries are absent."""
    return live.groupBy(*by or ("key",)).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("subkey", "value")))).alias("entries"))


def lookup(live: DataFrame, subkey, *by: str) -> DataFrame:
    """(key, value, present) of one entry per key that has any; combined before the shuffle, no map is gathered."""
    wanted = F.col("subkey") == F.lit(subkey)
    return live.groupBy(*by or ("key",)).agg(F.max(F.when(wanted, F.col("value"))).alias("value"), F.max(wanted).alias("present"))


def multi_get(live: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries for wanted (key, subkey); nulls skipped, misses omitted."""
    return live.join(wanted.select("key", "subkey").dropna().distinct(), ["key", "subkey"], "left_semi")


def rewrite(live: DataFrame, value, seq: int) -> DataFrame:
    """The ops that set every entry to value(row): an iterator's setValue. A null value removes the entry."""
    changed = live.withColumn("value", value)
    return changed.select("key", "subkey", F.when(F.col("value").isNull(), "DELETE").otherwise("PUT").alias("op"), "value", F.lit(seq).cast("long").alias("seq"), "write_ms")
