"""A blocked Bloom filter of bounded size: built by a distributed bit_or, broadcast, and asked in batches.

A filter has 512-bit blocks of eight 64-bit words; a hash sets one bit in each word of its block. The number of
blocks follows the number of hashes between LEAST and MOST, so at most MOST rows of 72 bytes reach the driver and at
most 8 MB are broadcast. Beyond that the filter only lets more rows pass; it never loses one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST, HASHES_PER_BLOCK = 1 << 10, 1 << 17, 24


def blocks_for(n: int) -> int:
    return min(MOST, max(LEAST, 1 << max(0, (n // HASHES_PER_BLOCK) - 1).bit_length()))


def filter_words(hashes: DataFrame, blocks: int | None = None) -> np.ndarray:
    """(blocks, 8) uint64 from a column h (long)."""
    blocks = blocks or blocks_for(hashes.count())
    block = F.pmod(F.shiftrightunsigned("h", 47).bitwiseXOR(F.col("h").bitwiseAND(MOST - 1)), F.lit(blocks)).alias("b")
    words = [F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(h, {6 * i}) & 63 AS INT)))").alias(f"w{i}") for i in range(8)]
    rows = hashes.where("h is not null").groupBy(block).agg(*words).toArrow()
    filled = np.zeros((blocks, 8), np.int64)
    filled[rows.column("b").to_numpy()] = np.stack([rows.column(f"w{i}").to_numpy() for i in range(8)], 1) if len(rows) else 0
    return filled.view(np.uint64)


def maybe(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (int64 or uint64) may have been added."""
    h = hashes.view(np.uint64)
    block = (h >> np.uint64(47) ^ h & np.uint64(MOST - 1)) % np.uint64(len(words))
    hit = np.ones(len(h), bool)
    for i in range(8):
        hit &= words[block, i] >> (h >> np.uint64(6 * i) & np.uint64(63)) & np.uint64(1) == 1
    return hit


def may_hold(hashes: DataFrame):
    """A function of a long column: whether its value may be among hashes (column h)."""
    shared = hashes.sparkSession.sparkContext.broadcast(filter_words(hashes))

    @F.pandas_udf("boolean")
    def asked(h: pd.Series) -> pd.Series:
        return pd.Series(maybe(shared.value, h.to_numpy(np.int64)))

    return asked
