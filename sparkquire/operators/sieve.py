"""A bit set over 64-bit keys, sized by their number: rows that it clears need no shuffle.

A key in the set always passes; another one passes by chance.  What passes is joined exactly, so
the size of the set decides how much is shuffled, never the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two bits a key.  The set has BITS at least (1 MB) and 8 to 16 times as many bits as keys, so that at most one foreign row
#: in 20 passes, up to MOST_BITS (64 MB, which is broadcast).  Beyond 67 million keys more pass, and are joined by key.
BITS, MOST_BITS = 1 << 23, 1 << 29


class Sieve:
    """Built from the column ``key`` (long, hashes, different ones) of a cheap DataFrame: at most MOST_BITS / 64 numbers reach
    the driver.  Tasks get it by broadcast (``passes``), expressions by a subquery of one row (``may``)."""

    def __init__(self, keys: DataFrame):
        size = BITS
        while size < min(8 * keys.count(), MOST_BITS):
            size *= 2
        places = F.array(F.col("key"), F.shiftright("key", 32)).alias("at")
        at = keys.select(F.explode(F.array_distinct(F.transform(places, lambda x: x.bitwiseAND(F.lit(size - 1))))).alias("at"))
        words = at.select(F.shiftright("at", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("b"))
        found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        bits = np.zeros(size // 64, np.uint64)
        bits[np.asarray(found["w"])] = np.asarray(found["b"]).view(np.uint64)
        self.spark = keys.sparkSession
        self.shared = self.spark.sparkContext.broadcast(bits)

    def __getstate__(self) -> dict:
        return {"shared": self.shared}  # tasks need no session

    def passes(self, keys: np.ndarray) -> np.ndarray:
        bits, keep = self.shared.value, np.ones(len(keys), bool)
        for at in (keys, keys >> 32):
            at = at & (64 * len(bits) - 1)
            keep &= (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
        return keep

    def may(self, key: Column) -> Column:
        """Whether a key (long, not null) may be in the set, as a column expression: the set is a scalar
        subquery of one row, so no row meets Python and nothing is joined."""
        rows = self.spark.createDataFrame([(self.shared.value.view(np.int64).tolist(),)], "bits array<bigint>")
        bits, most = rows.scalar(), 64 * len(self.shared.value) - 1
        out = F.lit(True)
        for at in (key, F.shiftright(key, 32)):
            at = at.bitwiseAND(F.lit(most))
            out = out & (F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out
