"""Embedding near-dedup by an epsilon grid order join.

Cosine >= t between unit vectors is a distance of at most eps = sqrt(2 - 2t).
The leading principal directions are fitted on a bounded sample (SAMPLE rows);
they are orthonormal, so distances along them, together with the difference of
what remains of the two norms, never exceed true distances and any basis is
safe. Vectors are sorted by their grid cells of side eps on these directions
and cut into blocks of consecutive rows. The join recurses over intervals of
that sequence: a pair of intervals whose bounding boxes lie further apart than
eps is skipped with all it contains, others are split. The upper levels run on a
table of one row per block; surviving block pairs meet in one task each and go
on recursing down to LEAF vectors, which are multiplied in single precision;
what comes within its error of the threshold is decided in double precision.
Every vector is indexed, so recall is 1.

Where vectors form clusters nearly all pairs of intervals are skipped. Where they
fill all dimensions alike, no box is far from another and every pair of blocks
is multiplied out; a block then holds as many rows as BLOCK_BYTES allow, so
each vector is shuffled once per block and the products outweigh the shuffle.

Equal vectors are grouped first and stand as one row with a count, so a group
of copies costs one row. A task returns one row per linked vector: its number
of links there and the smallest vector that it reaches there.

Defined results: a vector that is null, empty or zero, or holds null or
non-finite components, links with nothing and is its own component. Vectors of
different length never link. Rows that share a vec_id are separate vectors. A
null vec_id is larger than every other one and never kept, unless no vector of
the component has an id (then component_id is null). An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldstone.llm.components import components, local_roots
from foldstone.llm.shared import stage

#: SAMPLE bounds the rows that the principal directions are fitted on; the last coordinate is the norm off all DIRECTIONS.
SAMPLE, DIRECTIONS, LEAF, FAN_OUT = 8192, 15, 512, 8
#: Vectors of a block in double precision, and rows that a block holds at least.
BLOCK_BYTES, LEAST_ROWS = 32 << 20, 4096


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    # scaled first: the square of a large or tiny component leaves the range of a double
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of the vectors of each length, from the Arrow buffers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, values = pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, values.reshape(-1, d) if len(at) == len(sizes) else values[starts[at][:, None] + np.arange(d)]


def _directions(distinct: DataFrame) -> np.ndarray:
    """(dimensions, DIRECTIONS) orthonormal columns, for the commonest length in the sample."""
    sample = distinct.orderBy("h1", "h2").limit(SAMPLE).select("embedding").toArrow().column(0)
    if not len(sample):
        return np.zeros((0, 0))
    _, x = max(_by_length(sample), key=lambda found: found[1].shape)
    x = _unit(x)
    _, axes = np.linalg.eigh(np.cov(x.T).reshape(x.shape[1], x.shape[1]) if len(x) > 1 else np.eye(x.shape[1]))
    return np.ascontiguousarray(axes[:, ::-1][:, :DIRECTIONS])


def block_rows(n: int, dimensions: int, tasks: int) -> int:
    """Rows of a block: enough pairs of blocks for the tasks, no more rows than fit BLOCK_BYTES."""
    return max(1, min(BLOCK_BYTES // (8 * max(1, dimensions)), max(LEAST_ROWS, n // math.isqrt(4 * tasks + 1))))


def _grid_order(distinct: DataFrame, eps: float) -> DataFrame:
    """distinct with its coordinates `p` and `block`, consecutive in grid order, and a `node` number."""
    spark = distinct.sparkSession
    axes = spark.sparkContext.broadcast(_directions(distinct))
    n, dimensions = distinct.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    rows = block_rows(n, dimensions or 1, spark.sparkContext.defaultParallelism)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = axes.value
        for batch in batches:
            out = np.zeros((batch.num_rows, DIRECTIONS + 1))
            for at, x in _by_length(batch.column("embedding")) if batch.num_rows else ():
                if x.shape[1] == len(a):
                    x = _unit(x)
                    out[at, : a.shape[1]] = x @ a
                    rest = x - out[at, : a.shape[1]] @ a.T
                    out[at, DIRECTIONS] = np.sqrt((rest * rest).sum(1))
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * (DIRECTIONS + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))], names=[*batch.schema.names, "p"])

    schema = T.StructType([*distinct.schema.fields, T.StructField("p", T.ArrayType(T.DoubleType()))])
    cells = F.transform("p", lambda x: F.floor(x / eps))
    ordered = distinct.mapInArrow(placed, schema).withColumn("cells", cells)
    ordered = ordered.repartitionByRange(max(1, -(-n // rows)), "cells", "p", "h1", "h2").sortWithinPartitions("cells", "p", "h1", "h2")
    ordered = stage(ordered.drop("cells").withColumn("node", F.monotonically_increasing_id()), "grid-order")
    part = F.shiftrightunsigned("node", 33)
    sizes = ordered.groupBy(part.alias("part")).count()  # one row per partition
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("count").over(first), F.lit(0)).alias("first"))
    rank = F.col("first") + F.col("node").bitwiseAND((1 << 33) - 1)
    return ordered.withColumn("part", part).join(sizes, "part").withColumn("block", F.floor(rank / rows)).drop("part", "first")


def _apart(a: str, b: str):
    """Squared distance of two boxes."""
    gaps = F.zip_with(
        F.arrays_zip(F.col(f"{a}.lo").alias("lo"), F.col(f"{a}.hi").alias("hi")), F.arrays_zip(F.col(f"{b}.lo").alias("lo"), F.col(f"{b}.hi").alias("hi")),
        lambda x, y: F.greatest(F.lit(0.0), x["lo"] - y["hi"], y["lo"] - x["hi"]),
    )
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def _box(lo, hi):
    each = range(DIRECTIONS + 1)
    return F.struct(F.array(*[F.min(lo(i)) for i in each]).alias("lo"), F.array(*[F.max(hi(i)) for i in each]).alias("hi")).alias("box")


def block_pairs(ordered: DataFrame, eps: float) -> DataFrame:
    """(a, b), a <= b: pairs of blocks that may hold a link, found by recursion over intervals of blocks."""
    boxes = stage(ordered.groupBy("block").agg(_box(lambda i: F.get("p", F.lit(i)), lambda i: F.get("p", F.lit(i)))).withColumnRenamed("block", "id"), "boxes")
    top = boxes.agg(F.max("id")).first()[0]
    levels = [boxes]
    while top is not None and top > 0:
        top //= FAN_OUT
        levels.append(levels[-1].groupBy(F.floor(F.col("id") / FAN_OUT).alias("id")).agg(_box(lambda i: F.get("box.lo", F.lit(i)), lambda i: F.get("box.hi", F.lit(i)))))
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in reversed(levels[:-1]):
        kid = level.withColumn("parent", F.floor(F.col("id") / FAN_OUT))
        down = (
            pairs.join(kid.select(F.col("parent").alias("a"), F.col("id").alias("ka"), F.col("box").alias("ba")), "a")
            .join(kid.select(F.col("parent").alias("b"), F.col("id").alias("kb"), F.col("box").alias("bb")), "b")
        )
        pairs = stage(down.where((F.col("ka") <= F.col("kb")) & (_apart("ba", "bb") <= eps * eps * (1 + 1e-6) + 1e-9)).select(F.col("ka").alias("a"), F.col("kb").alias("b")), "block-pairs")
    return pairs


def _join_intervals(x, px, y, py, same: bool, least: float, reach: float):
    """Index pairs with dot product >= least, by recursion over both sequences; i < j where same."""
    found = []
    todo = [(0, len(x), 0, len(y))]
    single = [v.astype(np.float32) for v in ([x] if same else [x, y])]
    near = np.float32(least - (x.shape[1] + 8) * 2.0**-23)  # dot products of unit vectors in single precision err by less
    while todo:
        i, ie, j, je = todo.pop()
        if i == ie or j == je or same and j + 1 >= je and i >= j:
            continue
        a, b = px[i:ie], py[j:je]
        gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
        if gap @ gap > reach:
            continue
        if ie - i <= LEAF and je - j <= LEAF:
            at = np.flatnonzero(single[0][i:ie] @ single[-1][j:je].T >= near)
            u, v = at // (je - j) + i, at % (je - j) + j
            if same:
                u, v = u[u < v], v[u < v]
            for start in range(0, len(u), 4 * LEAF):
                p, q = u[start : start + 4 * LEAF], v[start : start + 4 * LEAF]
                sure = np.einsum("ij,ij->i", x[p], y[q]) >= least
                found.append((p[sure], q[sure]))
            continue
        im, jm = ((i + ie) // 2, (j + je) // 2) if ie - i > LEAF and je - j > LEAF else ((i + ie) // 2, je) if ie - i > LEAF else (ie, (j + je) // 2)
        todo += [(p, pe, q, qe) for p, pe in ((i, im), (im, ie)) for q, qe in ((j, jm), (jm, je)) if not same or p < qe - 1]
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))


def near_vectors(ordered: DataFrame, pairs: DataFrame, cosine: float) -> DataFrame:
    """(node, low, links): per block pair, each linked node, the smallest node it reaches there, and its links there."""
    reach = (2 - 2 * cosine) * (1 + 1e-6) + 1e-9

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("node").combine_chunks()
        column = lambda name: table.column(name).to_numpy()
        right, node, n = column("right"), column("node"), column("n")
        p = table.column("p").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        links = np.zeros(len(node), np.int64)
        ends: list[list[np.ndarray]] = [[], []]
        for at, vectors in _by_length(table.column("embedding")):
            here = _unit(vectors)
            left = ~right[at]
            same = bool(left.all()) and not right.any()
            left_at, x = at[left], here[left]
            right_at, y = (left_at, x) if same else (at[~left], here[~left])
            i, j = _join_intervals(x, p[left_at], y, p[right_at], same, cosine, reach)
            i, j = left_at[i], right_at[j]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            for to, e in zip(ends, (i, j)):
                to.append(e)
        i, j = (np.concatenate([*e, np.empty(0, np.int64)]).astype(np.int64) for e in ends)
        low = local_roots(len(node), i, j)
        linked = np.flatnonzero(links)
        return pa.table({"node": node[linked], "low": node[low[linked]], "links": links[linked]})

    rows = ordered.select("block", "node", "n", "embedding", "p")
    left = rows.join(pairs.withColumn("block", F.col("a")), "block").withColumn("right", F.lit(False))
    right = rows.join(pairs.where("a <> b").withColumn("block", F.col("b")), "block").withColumn("right", F.lit(True))
    return left.unionByName(right).drop("block").groupBy("a", "b").applyInArrow(meet, "node long, low long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector."""
    eps = math.sqrt(2 - 2 * cosine)
    sound = F.coalesce(
        (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    keyed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", sound.alias("sound"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    # 128 bits name a vector; the vectors themselves travel once
    distinct = stage(keyed.where("sound").groupBy("h1", "h2").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")), "vectors")
    ordered = _grid_order(distinct, eps)
    found = stage(near_vectors(ordered, block_pairs(ordered, eps), cosine), "near-vectors")
    roots = components(found.select(F.col("node").alias("u"), F.col("low").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    each = ordered.select("h1", "h2", "node", "n", "first_id").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = each.groupBy("root").agg(F.min("first_id").alias("component"))
    each = each.join(least, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component", F.lit(True).alias("sound"))
    out = keyed.drop("embedding").join(each, ["sound", "h1", "h2"], "left")
    component = F.when(F.col("sound"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), 0.9)


ORACLE_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT reach.u, l.w FROM reach JOIN l ON reach.w = l.u),
c AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT c.u AS vec_id, coalesce(n.n, 0) AS n_links, component_id, c.u = component_id AS kept FROM c LEFT JOIN n ON c.u = n.u
"""
