"""A bit array of the hashes of a table, for leaving out rows before a shuffle.

A row whose bit is not set is surely not in the table. One whose bit is set may be, which
the exact step afterwards decides; so the array's size, which is bounded, changes what is
sent and never what is found.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and the most bits (32 MB), which larger tables share.
BITS_EACH = 32
MOST_BITS = 1 << 28
#: A hash sets two bits: one by its low bits, one by the bits above these.
_SECOND = 28


class HashFilter:
    """Which 64-bit hashes may be in a table; sent to the tasks once."""

    def __init__(self, hashes: DataFrame, column: str, most_bits: int = MOST_BITS):
        count = hashes.count()
        bits = 1 << 12
        while bits < min(count * BITS_EACH, most_bits):
            bits *= 2
        self.mask = bits // 64 - 1
        # Not the highest bits: those of hashes that are the least of several are skewed.
        both = F.array(F.col(column), F.shiftrightunsigned(F.col(column), _SECOND))
        each = hashes.select(F.explode(both).alias("hash"))
        word = F.shiftrightunsigned("hash", 6).bitwiseAND(F.lit(self.mask)).alias("word")
        bit = F.expr("shiftleft(1L, cast(hash & 63 as int))")
        found = each.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
        words = np.zeros(self.mask + 1, np.int64)
        words[found["word"].to_numpy()] = found["bits"].to_numpy()
        self.words = hashes.sparkSession.sparkContext.broadcast(words.tobytes())

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        words = np.frombuffer(self.words.value, np.uint64)
        wide = hashes.view(np.uint64)
        return self._set(words, wide) & self._set(words, wide >> np.uint64(_SECOND))

    def _set(self, words: np.ndarray, wide: np.ndarray) -> np.ndarray:
        found = words[(wide >> np.uint64(6)).astype(np.int64) & self.mask]
        return (found >> (wide & np.uint64(63))) & np.uint64(1) == 1
