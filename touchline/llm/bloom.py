"""A Bloom filter of 64-bit hashes, built by Spark and sent to every task.

It has at most MOST_BITS bits (32 MB) at any input size, so what is sent is bounded.  Up to some 16 million
ids about 0.2 % of others pass; with more ids more pass, so it only ever spares work: an exact join follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 28  # as a power of 2
BITS_AN_ID = 16
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _bits(ids: np.ndarray, power: int) -> np.ndarray:
    """The bit numbers of each id, one row a factor."""
    x = ids.view(np.uint64)
    x = x ^ (x >> np.uint64(32))
    return (x[None, :] * _FACTORS[:, None]) >> np.uint64(64 - power)


def build(ids: DataFrame, n: int, column: str = "fp") -> np.ndarray:
    """The filter of ``n`` ids as an array of 64-bit words, a power of two of them."""
    power = min(MOST_BITS, max(6, (n * BITS_AN_ID - 1).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(_bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), power))
            word, first = np.unique(bits >> np.uint64(6), return_index=True)
            if len(word):
                mask = np.bitwise_or.reduceat(np.uint64(1) << (bits & np.uint64(63)), first)
                yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    found = ids.select(column).where(F.col(column).isNotNull()).mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << power - 6, np.int64)
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return out.view(np.uint64)


def holds(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id may be in the filter; all that are in it are."""
    bits = _bits(ids, (len(words) * 64 - 1).bit_length())
    return ((words[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63))) & np.uint64(1)).all(0)
