"""Line dedup over levelled sorted runs of line hashes.

A run is a Parquet table (h1, h2, n_docs, holder) sorted by the 128-bit hash of
the line key. Batches arrive by descending doc_id. Each one is aggregated to
its distinct keys, merge-anti-joined with the keys that the runs already know
to be frequent (nothing about those can change), and what is left is written
as a new run on level 0. A level that holds `fanout` runs is merged into one
run of the next level, so a key is rewritten once per level. At the end one
merge of the few remaining runs gives the frequent keys and their holders.

Text never enters the runs. A line carries 28 bytes (row, position, hash)
through the joins; a hot line is one row per task after map-side combine, and
its probe side is left to the skew join.

Defined results: null or empty text is one empty line. Rows are documents: two
rows that share a doc_id count twice, and if that doc_id is the largest holder
both keep the line. A null doc_id ranks below every other one. An empty table
gives an empty result. Extra columns are ignored by the decision and passed on
by `dedup_lines`; those that share a name with an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.llm.shared import SPACE, arrow_rows, new_path, remove, row_key, stage

BATCHES, FANOUT = 4, 3


class LineRuns:
    """The levelled index. add() must see batches by descending doc_id."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = [[]]

    def _runs(self) -> list[str]:
        return [path for level in self.levels for path in level]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n_docs long, holder long").parquet(*paths)

    def _write(self, run: DataFrame) -> str:
        path = new_path(self.spark, "line-run")
        run.sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def _merged(self, paths: list[str]) -> DataFrame:
        return self._read(paths).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))

    def add(self, lines: DataFrame) -> None:
        """lines: (doc_id, first, h1, h2), one row per line."""
        own = lines.where("first").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder"))
        if known := self._runs():
            settled = self._read(known).where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
            own = own.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(own.select("h1", "h2", "n_docs", "holder")))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._write(self._merged(self.levels[level]))
            for path in self.levels[level]:
                remove(self.spark, path)
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1

    def frequent(self) -> DataFrame:
        return self._merged(self._runs()).where(F.col("n_docs") >= self.min_docs)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, rk, pos, first, h1, h2): the lines whose key has at least min_chars code points."""

    def rows(each: Iterator[dict]) -> Iterator[tuple]:
        for doc in each:
            seen = set()
            for pos, line in enumerate((doc["text"] or "").split("\n")):
                key = line.strip(SPACE)
                if len(key) >= min_chars:
                    # bytes.lower() folds A-Z only
                    h = xxhash.xxh3_128_intdigest(key.encode().lower())
                    yield doc["doc_id"], doc["rk"], pos, h not in seen, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)
                    seen.add(h)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key("text").alias("rk"))
    return arrow_rows(picked, "doc_id long, rk long, pos int, first boolean, h1 long, h2 long", rows, 16384)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES) -> DataFrame:
    """docs with text replaced by its kept lines, plus n_lines and n_dropped (long)."""
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("double").alias("d"))
    cuts = ids.approxQuantile("d", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges = [float("-inf"), *sorted(set(cuts))]
    batch = sum((F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))) >= e).cast("int") for e in edges[1:]) if len(edges) > 1 else F.lit(0)
    lines = stage(line_hashes(docs, min_chars).withColumn("batch", F.lit(0) + batch), "line-hashes", "batch")
    runs = LineRuns(spark, min_docs)
    for b in reversed(range(len(edges))):
        runs.add(lines.where(F.col("batch") == b))
    # staged, so that both sides of the join come from plain exchanges and a hot line's side can be split
    hot = stage(runs.frequent().select("h1", "h2", "holder"), "frequent-lines")
    dropped = (
        lines.join(hot, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("holder")))
        .groupBy(F.col("doc_id").alias("__id"), F.col("rk").alias("__rk"))
        .agg(F.collect_set("pos").alias("__dropped"))
    )
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    own = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    joined = docs.select(*own, "text", row_key("text").alias("__rk2")).join(
        dropped.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__rk2") == F.col("__rk")), "left"
    )
    gone = F.coalesce(F.col("__dropped"), F.array().cast("array<int>"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), gone), lambda p: F.get(F.col("__lines"), p))
    return (
        joined.withColumn("__lines", split)
        .select(
            *own,
            F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
            F.size("__lines").cast("long").alias("n_lines"),
            F.size(gone).cast("long").alias("n_dropped"),
        )
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: translate(): A-Z only. DuckDB's trim() takes the set of characters to strip.
ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
f AS (SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, f.holder IS NOT NULL AND f.holder <> l.doc_id AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
