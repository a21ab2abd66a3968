"""Mixing sources to target weights by weighted fair queueing.

Targets come from water filling over the sources: weight times a common level,
stopped at `most_repeats` times the source's size. Documents of a source are
shuffled by a hash of their id and read up to `most_repeats` times; a copy's
virtual finish time is the source's words up to and including it divided by
the source's target. All copies are ordered by finish time over the whole
corpus and taken until the total budget is spent, so every source runs out at
about virtual time 1 and gets its target to within about one document.

Prefix sums never gather a source in one task: a document falls into one of
many hash ranges of its source, range totals are summed first (one row per
source and range), and only the few documents of a range are ordered in a
window. The global order is cut the same way: finish times fall into ranges, a
running total of the ranges names the one in which the budget ends, and only
that range is ordered. The number of ranges follows the number of documents, so
that about RANGE_ROWS fall into each. All built-in functions.

Defined results: null or empty texts have size 0 and are never taken. A null
source is a source of its own, ordered last. A source without words has target
0. Rows that share a doc_id are ordered by their size, rows without one by a
hash of their text; rows equal in all of this are ordered arbitrarily, which no
result can tell. An empty table gives an empty
result; extra columns are ignored by `mix` and kept by `mixed_documents`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldstone.llm.shared import stage

WEIGHTS, BUDGET, MOST = (5, 2, 1), 1.5, 2
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 8192, 1 << 10, 1 << 24


def word_count(text):
    """Number of [^\\x20\\x09-\\x0D]+ in the text."""
    spaced = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(spaced == "", F.lit(0)).otherwise(F.size(F.split(spaced, " +"))).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], budget: float, most: int) -> DataFrame:
    """(source, source_size, target): water filling in closed form. sizes: (source, source_size), one row per source."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(every) - 1) % len(weights)).cast("int"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    below, whole = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = Window.orderBy(F.desc("ratio"), F.col("source").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sizes.withColumn("w", w)
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(whole) * F.lit(float(budget)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(above))
        # the first source, by ratio, that the level does not fill
        .withColumn("settled", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"])
        .select("source", "source_size", F.when(F.col("settled").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("settled"))).alias("target"))
    )


def ranges_for(rows: int) -> int:
    """A power of two, so that ranges of hashes are their leading bits."""
    return min(MOST_RANGES, max(LEAST_RANGES, 1 << (rows // RANGE_ROWS).bit_length()))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most_repeats: int = MOST, ranges: int | None = None) -> DataFrame:
    """(doc_id, rk, size, source, source_size, target, taken); taken = size times the copies that the mix takes."""
    shuffled = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    slim = stage(docs.select("doc_id", F.xxhash64("text").alias("rk"), "source", word_count(F.col("text")).alias("size"), shuffled.alias("hash")), "mix")
    ranges = ranges or ranges_for(slim.count())
    slim = slim.withColumn("slot", F.shiftright(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long"), 32 - (ranges.bit_length() - 1)))
    by_slot = slim.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    by_slot = stage(by_slot.withColumn("slot_from", F.coalesce(F.sum("slot_size").over(before), F.lit(0))), "mix-slots")
    targets = source_targets(by_slot.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, budget, most_repeats)
    slot_info = by_slot.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("__source"), F.col("slot").alias("__slot"), "slot_from", "source_size", "target")
    inside = Window.partitionBy("source", "slot").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("slot_from") + F.col("inside")
    queued = stage(
        slim.withColumn("inside", F.sum("size").over(inside))
        .join(slot_info, F.col("source").eqNullSafe(F.col("__source")) & (F.col("slot") == F.col("__slot")))
        .select("doc_id", "rk", "size", "source", "source_size", "target", "hash", *[((F.lit(k) * F.col("source_size") + upto) / F.nullif(F.col("target"), F.lit(0.0))).alias(f"finish{k}") for k in range(most_repeats)]),
        "mix-queue",
    )
    # every copy that ends by virtual time 1 is inside the budget; the cut lies in a range soon after it
    copies = queued.where("size > 0").select("doc_id", "size", "hash", "source", F.posexplode(F.array(*[F.col(f"finish{k}") for k in range(most_repeats)])).alias("copy", "finish"))
    ranged = copies.withColumn("range", F.least(F.floor(F.col("finish") * ranges), F.lit(2 * ranges)))
    totals = ranged.groupBy("range").agg(F.sum("size").alias("n"))
    total = slim.agg((F.coalesce(F.sum("size"), F.lit(0)) * F.lit(float(budget))).alias("budget"))
    running = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        totals.withColumn("upto", F.sum("n").over(running)).crossJoin(F.broadcast(total)).where(F.col("upto") > F.col("budget"))
        .agg(F.min(F.struct("range", (F.col("upto") - F.col("n")).alias("spent"), "budget")).alias("e")).select("e.*")
    )  # one row: the range in which the budget ends
    order = Window.orderBy("finish", "hash", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        ranged.join(F.broadcast(ends.withColumnRenamed("range", "at")), F.col("range") == F.col("at"))
        .withColumn("spent", F.col("spent") + F.sum("size").over(order))
        .where(F.col("spent") > F.col("budget"))
        .agg(F.min(F.struct("finish", "hash", "doc_id", "size", "copy")).alias("cut"))
    )  # one row: the first copy that no longer fits
    took = sum(
        F.when((F.col("size") > 0) & (F.col("cut").isNull() | (F.struct(F.col(f"finish{k}").alias("finish"), "hash", "doc_id", "size", F.lit(k).alias("copy")) < F.col("cut"))), F.col("size")).otherwise(F.lit(0))
        for k in range(most_repeats)
    )
    return queued.crossJoin(F.broadcast(cut)).select("doc_id", "rk", "size", "source", "source_size", "target", took.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    taken = mix(docs, **options).where("taken > 0").select(F.col("doc_id").alias("__id"), F.col("rk").alias("__rk"), (F.col("taken") / F.col("size")).cast("int").alias("__n"))
    return _repeated(docs, taken)


def _repeated(docs: DataFrame, taken: DataFrame) -> DataFrame:
    # rows equal in id and text are told apart by their number, which no result can tell from another
    nth = Window.partitionBy("__id", "__rk").orderBy(F.col("__n").desc())
    own = Window.partitionBy("doc_id", "__key").orderBy("source")
    keyed = docs.withColumn("__key", F.xxhash64("text")).withColumn("__row", F.row_number().over(own))
    joined = keyed.join(taken.withColumn("__nth", F.row_number().over(nth)), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__rk")) & (F.col("__row") == F.col("__nth")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*[F.col(c) for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS hash,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 2.0::DOUBLE AS cap,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
l AS (SELECT *, cap / w AS ratio,
             ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE
               - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, w * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio)) AS target FROM l),
q AS (SELECT d.*, source_size, target,
             sum(size) OVER (PARTITION BY d.source ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, hash, size, k AS copy, CAST(k * source_size + upto AS DOUBLE) / nullif(target, 0) AS finish
      FROM q, (VALUES (0), (1)) v(k) WHERE size > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, hash, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS spent FROM c),
k AS (SELECT doc_id, hash, size, count(*) FILTER (WHERE spent <= (SELECT sum(size) FROM d) * 1.5) AS n FROM g GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(k.n, 0) * q.size AS BIGINT) AS taken
FROM q LEFT JOIN k ON q.doc_id = k.doc_id AND q.hash = k.hash AND q.size = k.size
"""
