"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two aggregations and two joins whose output goes to the shared
folder, so nothing is gathered on the driver and a lost executor costs one
round at most. The first aggregation also counts what still is no star. Minima are combined map-side before the shuffle, so the centre
of a large star costs one row per task; the joins' hot side is left to the
skew join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from foldstone.llm.shared import release, stage


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not np.array_equal(root, jumped := root[root]):
            root = jumped
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): every node that has an edge, with the smallest node it can reach. edges: (u, v) long."""
    work = stage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(), "edges"
    )
    for _ in range(most_rounds):
        both = work.union(work.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("x", "y")
        seen = Observation()
        # in a set of stars a node has larger neighbours only, or one
        kinds = both.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n")).observe(seen, F.count_if(F.expr("m < x and n > 1")).alias("unfinished"))
        least = stage(kinds.select("x", F.least("x", "m").alias("m")), "least")
        if not seen.get["unfinished"]:
            release(least)
            break
        large = both.join(least, "x").where("y > x and y <> m").select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        turned = stage(small.union(low.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        release(work, least)
        work = turned
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return work.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(work.select("lo", "lo").distinct())
