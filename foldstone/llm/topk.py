"""Exact top-k search by inner product, term at a time.

Queries and candidates are cut into blocks of bounded size; every query block
meets every candidate block in one task. There each term (a vector component)
has a posting list of the block's candidates, and the queries that carry the
term scatter their weighted postings into dense score arrays. A partition
selection keeps the k best of the block per query; a window over k rows per
candidate block merges them. Nothing is broadcast and no result is dropped: a
candidate outside its block's k best cannot be among the k best of all. A
candidate travels once per QUERY_BLOCK queries, so the products outweigh the
shuffle by the number of queries in a block.

Scores are integers: components become floor(scale * x), computed in doubles;
values beyond 64 bits saturate and sums wrap, as Spark's long does.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows without vec_id. Rows sharing a vec_id take part each, but
never meet one another; rows equal in vec_id and vector count as one. A missing component counts as 0, so vectors of other
lengths meet. Ties go to the smaller vec_id. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldstone.llm.shared import stage

QUERY_BLOCK, ROW_BLOCK, SLICE = 1 << 14, 8192, 256


def quantised(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, terms array<long>) of the rows that take part."""
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fits)
        .select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").distinct()
        .select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("terms"))
    )


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Dense scores (queries, rows), one term's postings after the other."""
    scores = np.zeros((len(queries), len(rows)), np.int64)
    for term in range(queries.shape[1]):
        of, at = np.flatnonzero(queries[:, term]), np.flatnonzero(rows[:, term])
        if not len(of) or not len(at):
            continue
        weighted = queries[of, term][:, None] * rows[at, term][None, :]
        if len(of) == len(queries) and len(at) == len(rows):
            scores += weighted
        else:
            scores[np.ix_(of, at)] += weighted
    return scores


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best by (score desc, id asc); ids ascend."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        s = scores[at]
        least = np.partition(s, len(s) - k)[len(s) - k]
        above = at[s > least]
        at = np.concatenate((above, at[s == least][: k - len(above)]))
    return at


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    lengths = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _each(n: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def top_k(vectors: DataFrame, is_query, k: int, scale: float, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query, its k best other rows."""
    rows = stage(quantised(vectors, scale).withColumn("q", is_query), "terms")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    row_blocks, query_blocks = max(1, -(-n // row_block)), max(1, -(-n_queries // query_block))
    spread = F.xxhash64("vec_id")
    as_rows = rows.select("vec_id", "terms", F.lit(False).alias("asks"), F.pmod(spread, F.lit(row_blocks)).alias("rb"), _each(query_blocks).alias("qb"))
    as_queries = rows.where("q").select("vec_id", "terms", F.lit(True).alias("asks"), _each(row_blocks).alias("rb"), F.pmod(spread, F.lit(query_blocks)).alias("qb"))

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids = table.column("vec_id").to_numpy()
        width = int(np.diff(table.column("terms").combine_chunks().offsets.to_numpy()).max(initial=0))
        terms = _matrix(table.column("terms"), width)
        q_ids, r_ids, q, r = ids[asks], ids[~asks], terms[asks], np.asfortranarray(terms[~asks])
        out: list[list[np.ndarray]] = [[], [], []]
        for start in range(0, len(q), SLICE):
            scores = _scores(q[start : start + SLICE], r)
            for own, line in zip(q_ids[start : start + SLICE], scores):
                at = _best(line, r_ids, own, k)
                for to, x in zip(out, (np.full(len(at), own), r_ids[at], line[at])):
                    to.append(x)
        return pa.table({name: np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for name, x in zip(("query_id", "vec_id", "score"), out)})

    met = as_rows.unionByName(as_queries).groupBy("qb", "rb").applyInArrow(meet, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0, 5, 256.0)


ORACLE_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS t FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.t, c.t) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
