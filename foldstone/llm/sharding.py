"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has `arcs` equal arcs. A document's id hashes to an arc; each shard
owns `virtual` points of the ring. An arc goes to the shard of the first point
clockwise from it. A shard is full once it holds (1 + slack) times the mean
load in bytes; arcs that no longer fit continue clockwise to the next shard
that they have not tried. Inside a shard, arcs that came in an earlier round
keep their place, and larger arcs go first, so those that move on are small and
fill the other shards evenly. Rounds go on until every arc has a place. If a
full turn of the ring places nothing more, the slack is doubled, or raised to
what the least waiting arc needs beside the least loaded shard if that is more: a
load that no shard can take within the slack (an arc above the mean, say) raises
the bound for the arcs still without a place and for nothing else. Adding a shard moves what its points take over plus the overflow.

Everything sequential runs on one row per arc (at most `arcs` rows, whatever
the input); documents are read once for the arc totals and once for the
result, and are numbered inside their arc, a small share of a shard. Built-in
functions only.

The law that holds is `bytes`: no shard exceeds (1 + slack) times the mean
while arcs are small against a shard. Defined results: a null text has size 1
and CRC 0. Rows without doc_id are placed by their text. Rows that share a
doc_id go to the same shard. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldstone.llm.shared import release, stage

SHARDS, VIRTUAL, ARCS, SLACK, LEAST_SLACK = 8, 64, 1 << 14, 0.002, 0.001


def ring_order(spark: SparkSession, shards: int, virtual: int, arcs: int) -> DataFrame:
    """(arc, tries): for every arc the shards in the order in which their points follow it clockwise."""
    points = (
        spark.range(shards * virtual)
        .select(F.floor(F.col("id") / virtual).cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit("point"), "id"), F.lit(arcs)).alias("at"))
        .groupBy("at").agg(F.collect_set("shard").alias("here"))
    )
    whole = spark.range(arcs).withColumnRenamed("id", "arc").join(F.broadcast(points), F.col("arc") == F.col("at"), "left")
    # from the last arc back, so that the minimum of what follows is a running one
    onward = Window.orderBy(F.desc("arc")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = []
    for s in range(shards):
        at = F.when(F.array_contains("here", s), F.col("arc"))
        steps.append(F.struct((F.coalesce(F.min(at).over(onward), F.min(at).over(first) + arcs) - F.col("arc")).alias("d"), F.pmod(F.xxhash64("arc", F.lit(s)), F.lit(1 << 30)).alias("tie"), F.lit(s).alias("s")))
    return whole.select("arc", F.transform(F.array_sort(F.array(*steps)), lambda x: x["s"]).alias("tries"))


def place_arcs(loads: DataFrame, shards: int, virtual: int, arcs: int, slack: float) -> DataFrame:
    """(arc, shard). loads: (arc, load), at most `arcs` rows."""
    spark = loads.sparkSession
    mean = loads.agg((F.sum("load") / F.lit(shards)).alias("mean"))
    placed = (
        loads.join(ring_order(spark, shards, virtual, arcs), "arc").crossJoin(F.broadcast(mean))
        .withColumn("try", F.lit(0)).withColumn("since", F.lit(0))
    )
    turn, waiting, stuck = 0, None, 0
    while True:
        turn += 1
        room = F.col("mean") * (1 + slack)
        # an arc that is too large by itself does not keep those behind it waiting
        held = Window.partitionBy("shard").orderBy("since", F.col("load") > room, F.desc("load"), "arc").rowsBetween(Window.unboundedPreceding, 0)
        tried = placed.withColumn("shard", F.get("tries", F.col("try") % shards)).withColumn("upto", F.sum("load").over(held))
        moves = F.col("upto") > room
        moved = stage(
            tried.withColumn("try", F.col("try") + F.when(moves, 1).otherwise(0)).withColumn("since", F.when(moves, F.lit(turn)).otherwise(F.col("since"))).drop("shard", "upto"),
            "ring",
        )
        if turn > 1:
            release(placed)
        placed, before = moved, waiting
        waiting = placed.where(F.col("since") == turn).count()
        if not waiting:
            return placed.select("arc", F.get("tries", F.col("try") % shards).alias("shard"))
        # what found a place keeps it, so a full turn of the ring in which nothing does can only repeat itself
        stuck = stuck + 1 if waiting == before else 0
        if stuck >= shards:
            kept = placed.where(F.col("since") < turn).groupBy(F.get("tries", F.col("try") % shards)).agg(F.sum("load").alias("held")).agg(F.coalesce(F.min("held"), F.lit(0))).first()[0]
            least, share = placed.where(F.col("since") == turn).agg(F.min("load"), F.first("mean")).first()
            slack, stuck = max(2 * slack, LEAST_SLACK, (kept + least) / share - 1), 0


def shard_documents(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, arcs: int = ARCS, slack: float = SLACK) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot)"""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = stage(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("text"), text)).otherwise(F.xxhash64("doc_id")), F.lit(arcs)).alias("arc")),
        "shard-sizes",
    )
    loads = stage(sized.groupBy("arc").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("n")), "ring-loads")
    before = Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    where = (
        place_arcs(loads.select("arc", "load"), shards, virtual, arcs, slack)
        .join(loads.select("arc", "n"), "arc")
        .select("arc", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    inside = Window.partitionBy("arc").orderBy("doc_id", "text_crc32", "size")
    return (
        sized.withColumn("__n", F.row_number().over(inside) - 1)
        .join(where, "arc")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("__n")).cast("long").alias("slot"))
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
