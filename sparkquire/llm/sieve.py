"""Leaving out rows by key: the bit set of ``operators.sieve`` clears those that need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sieve import BITS, MOST_BITS, Sieve
from ..storage import cut

__all__ = ["BITS", "MOST_BITS", "Sieve", "leave_out"]


def leave_out(docs: DataFrame, gone: DataFrame, key: Column, extra: str) -> DataFrame:
    """The rows of ``docs`` whose (key, ``extra``) isn't in ``gone`` (columns key and extra, a checkpointed
    or cheap frame).  key: a 64-bit hash that is never null; extra: a column of both, compared
    with null equal to null.  Only rows whose key may be in ``gone`` are shuffled."""
    gone = cut(gone.select("key", F.col(extra).alias("extra")).distinct())
    sieve = Sieve(gone)
    marked = docs.select(*docs.columns, key.alias(" key"))
    clear = marked.where(~sieve.may(F.col("` key`"))).select(*docs.columns)
    rest, gone = marked.where(sieve.may(F.col("` key`"))).alias("d"), gone.alias("g")
    rest = rest.join(gone, (F.col("d.` key`") == F.col("g.key")) & F.col(f"d.{extra}").eqNullSafe(F.col("g.extra")), "left_anti")
    return clear.unionByName(rest.select(*docs.columns))
