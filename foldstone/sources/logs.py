"""Mutation logs derived from tables, with the null rules applied before any fold.

ops: key, ns, subkey, op (PUT, APPEND, DELETE), value, seq, write_ms
timers: key, ts_ms, op (ADD, REMOVE), seq
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPS = ("key", "ns", "subkey", "op", "value", "seq", "write_ms")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def event_ops(events: DataFrame, kind: str = "value", subkey: str = "event_type") -> DataFrame:
    """Value and map: error deletes, the rest puts. List: error deletes, signup puts, the rest appends."""
    kept = F.lit("PUT") if kind != "list" else F.when(F.col("event_type") == "signup", "PUT").otherwise("APPEND")
    sub = F.col("event_type") if subkey == "event_type" else F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return events.select(
        F.col("user_id").alias("key"), F.to_date("ts").alias("ns"), sub.alias("subkey"),
        F.when(F.col("event_type") == "error", "DELETE").otherwise(kept).alias("op"),
        "value", F.col("event_id").alias("seq"), epoch_ms(F.col("ts")).alias("write_ms"),
    )


def order_timers(orders: DataFrame) -> DataFrame:
    """A timer per customer and order date; finished orders remove theirs."""
    return orders.select(
        F.col("o_custkey").alias("key"), epoch_ms(F.col("o_orderdate")).alias("ts_ms"),
        F.when(F.col("o_orderstatus") == "F", "REMOVE").otherwise("ADD").alias("op"), F.col("o_orderkey").alias("seq"),
    )


def conversation_ops(conversations: DataFrame) -> DataFrame:
    """Turns append to their conversation's list."""
    return conversations.select(F.col("conv_id").alias("key"), F.lit("APPEND").alias("op"), F.col("text").alias("value"), F.col("turn").alias("seq"))


def null_rules(ops: DataFrame, kind: str) -> DataFrame:
    """A null key is refused where it is read. A null value deletes value state and is ignored elsewhere."""
    keyed = ops.where(F.col("key").isNotNull())
    if kind == "value":
        return keyed.withColumn("op", F.when((F.col("op") == "PUT") & F.col("value").isNull(), "DELETE").otherwise(F.col("op")))
    if kind == "map":
        return keyed.where((F.col("op") == "DELETE") | F.col("subkey").isNotNull() & F.col("value").isNotNull())
    return keyed.where((F.col("op") == "DELETE") | F.col("value").isNotNull())


def list_appends(batches: DataFrame) -> DataFrame:
    """Bulk appends (key, elements array, seq) as ops, one per element in its place; refused whole if an element is null."""
    others = [c for c in batches.columns if c != "elements"]
    sound = F.coalesce(F.forall("elements", lambda x: x.isNotNull()), F.lit(False))
    return batches.where(sound).select(*others, F.lit("APPEND").alias("op"), F.posexplode("elements").alias("pos", "value"))


def list_updates(updates: DataFrame, namespaced: bool) -> DataFrame:
    """Whole-list updates (key, elements array, seq) as ops, one per element.

    A list with a null element is refused whole. An empty list clears; a null
    list clears a namespaced list and leaves a keyed one as it is.
    """
    clear = F.coalesce(F.size("elements") == 0, F.lit(False)) | (F.col("elements").isNull() if namespaced else F.lit(False))
    sound = F.coalesce(F.forall("elements", lambda x: x.isNotNull()), F.lit(False))
    rows = updates.where(clear | sound & (F.size("elements") > 0))
    others = [c for c in updates.columns if c != "elements"]
    cleared = rows.where(clear).select(*others, F.lit("DELETE").alias("op"), F.lit(0).alias("pos"), F.lit(None).cast(updates.schema["elements"].dataType.elementType).alias("value"))
    put = rows.where(~clear).select(*others, F.lit("PUT").alias("op"), F.posexplode("elements").alias("pos", "value"))
    return put.unionByName(cleared)
