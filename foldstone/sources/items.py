"""Snapshot items on any file system that Spark writes to.

item: state_type, state_name, key_group, key, ns, map_key, value, write_ms. Files are
partitioned by ranges of key groups, so a restore prunes to its own range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = ("state_type", "state_name", "key_group", "key", "ns", "map_key", "value", "write_ms")


def write_items(items: DataFrame, path: str, groups_per_directory: int = 128, compression: str = "lz4_raw") -> None:
    """Export, sorted by key group inside each file. Deleting a savepoint is deleting its directory."""
    (
        items.withColumn("group_range", F.floor(F.col("key_group") / groups_per_directory).cast("int"))
        .repartitionByRange("group_range", "key_group", "key")
        .sortWithinPartitions("group_range", "key_group", "key")
        .write.partitionBy("group_range").option("compression", compression).parquet(path)
    )


def read_items(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, groups_per_directory: int = 128) -> DataFrame:
    """Items of key groups first … last; other directories are never listed, other row groups never read."""
    items = spark.read.parquet(path)
    if first is not None:
        items = items.where((F.col("group_range") >= first // groups_per_directory) & (F.col("key_group") >= first))
    if last is not None:
        items = items.where((F.col("group_range") <= last // groups_per_directory) & (F.col("key_group") <= last))
    return items.drop("group_range")


def read_live_state(spark: SparkSession, checkpoint: str, variable: str, batch_id: int | None = None) -> DataFrame:
    """A state variable of a streaming query's checkpoint, at a batch if one is named."""
    reader = spark.read.format("statestore").option("stateVarName", variable).option("flattenCollectionTypes", True)
    return (reader if batch_id is None else reader.option("batchId", batch_id)).load(checkpoint)
