"""Embedding near-dedup and top-k search: SQL, brute force, and the edge cases of each docstring."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.llm import embedding_dedup, topk
from tests import oracle
from tests.llm.test_text_operators import groups

VECTORS = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("module, query", [(embedding_dedup, "op2_embedding_dedup"), (topk, "op10_topk")])
def test_matches_sql(spark, sf_dir, module, query):
    oracle.same(getattr(module, query)(spark, sf_dir), oracle.connect(sf_dir), module.ORACLE_SQL)


def brute_links(rows, least):
    def near(a, b):
        x, y = rows[a][1], rows[b][1]
        if not all(v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v) for v in (x, y)) or len(x) != len(y):
            return False
        x, y = np.float64(np.float32(x)), np.float64(np.float32(y))
        x, y = x / np.abs(x).max(), y / np.abs(y).max()
        return x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= least

    n = range(len(rows))
    links = [sum(near(a, b) for b in n if a != b) for a in n]
    return links, groups(list(n), near)


def test_near_duplicates_by_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAST_ROWS", 32)
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 32 * 12 * 8)
    monkeypatch.setattr(embedding_dedup, "LEAF", 8)
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 12))
    rows = [(i, v) for i, v in enumerate((base[r.integers(0, 40, 260)] + r.normal(scale=0.25, size=(260, 12))).tolist())]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(2000, [x * 7 for x in rows[3][1]])]
    links, root = brute_links(rows, 0.9)
    found = {x.vec_id: x for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    for k, (i, _) in enumerate(rows):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (links[k], rows[root[k]][0], rows[root[k]][0] == i)


def test_most_interval_pairs_of_clustered_vectors_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAST_ROWS", 64)
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 64 * 24 * 8)
    r = np.random.default_rng(7)
    centres = r.normal(size=(30, 24))
    rows = [(i, v) for i, v in enumerate((centres[np.arange(2400) % 30] + r.normal(scale=0.04, size=(2400, 24))).tolist())]
    seen, own = [], embedding_dedup.block_pairs

    def counted(ordered, eps):
        pairs = own(ordered, eps)
        seen.append((ordered.select("block").distinct().count(), pairs.count()))
        return pairs

    monkeypatch.setattr(embedding_dedup, "block_pairs", counted)
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert {x.component_id for x in found} == set(range(30)) and all(x.n_links == 79 for x in found)
    blocks, pairs = seen[0]
    assert blocks >= 35 and pairs < 0.45 * blocks * (blocks + 1) / 2


def test_vectors_that_fill_all_dimensions_are_shuffled_once_per_large_block():
    assert embedding_dedup.block_rows(50_000, 64, 6) == 10_000
    assert embedding_dedup.block_rows(10**9, 64, 4000) == 65_536


def test_near_duplicates_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1e30, 0.0]), (9, [1e-30, 0.0]), (9, [1.0, 0.0]), (10, [1.0]), (None, [1.0, 0.01]), (11, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, VECTORS).withColumn("h1", F.lit("clash"))
    found = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame).collect())
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 11)]
    assert found == sorted([*alone, (7, 4, 7, True), (8, 4, 7, False), (9, 4, 7, False), (9, 4, 7, False), (-1, 4, 7, False)])
    assert embedding_dedup.near_duplicates(frame.where("false")).count() == 0


def test_top_k_by_brute_force_in_small_blocks(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), v) for i, v in zip(r.permutation(300), np.round(r.normal(size=(300, 6)), 1).tolist())]
    rows += [(1000 + i, rows[0][1]) for i in range(9)] + [(rows[0][0], rows[0][1])]
    found = topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, 5, 4.0, query_block=7, row_block=50).collect()
    ints = {i: [math.floor(4 * float(np.float32(x))) for x in v] for i, v in rows}
    expected = set()
    for q in ints:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)[:5]
            expected |= {(q, k, c, -s) for k, (s, c) in enumerate(best, 1)}
    assert {tuple(x) for x in found} == expected and len(found) == len(expected)


def test_top_k_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0]), (2, None), (3, [nan, 1.0]), (4, [1.0, None]), (None, [5.0, 5.0]), (5, []), (6, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, VECTORS).withColumn("terms", F.lit("clash"))
    found = sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0, 5, 1.0).collect())
    assert found == [(0, 1, 1, 3), (0, 2, 6, 2), (0, 3, 5, 0)]
    assert topk.top_k(frame.where("false"), F.col("vec_id") % 50 == 0, 5, 1.0).count() == 0


def test_top_k_with_repeated_ids_matches_sql(spark, tmp_path):
    rows = [(0, [1.0, 2.0]), (0, [3.0, 0.0]), (1, [1.0, 1.0]), (1, [5.0, 0.0]), (1, [0.0, 9.0]), (2, [0.5, 0.5])]
    spark.createDataFrame(rows, VECTORS).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted(tuple(r)[::3] + (r["rank"], r.vec_id) for r in topk.op10_topk(spark, str(tmp_path)).collect())
    dot = lambda a, b: sum(256 * x * 256 * y for x, y in zip(a, b))
    best = sorted((-dot(q, c), i) for k, q in rows if k == 0 for i, c in rows if i)[:5]
    assert found == sorted((0, int(-s), n, i) for n, (s, i) in enumerate(best, 1))


def test_partition_selection_breaks_ties_by_id():
    at = topk._best(np.array([5, 7, 5, 5, 9]), np.array([1, 2, 3, 4, 5]), 5, 3)
    assert sorted(at.tolist()) == [0, 1, 2]
