"""Weighted rendezvous hashing of stable record keys into shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut

#: Hex digits of a record's order key that name its slot bucket: 4096 buckets a shard.
SLOT_DIGITS = 3


def rendezvous(key: Column, weights: Sequence[float], seed: str = "shard") -> Column:
    """The shard of each key: the one of the highest score ``-weight / ln(u)``, where u in
    (0, 1) is a hash of key and shard.  Adding a shard can only move keys into it, and
    raising a weight only into that shard.  A null key counts as the text ``null``; on a
    tie of scores the higher shard wins.  A weight of 0 takes nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a positive weight")
    if any(w < 0 for w in weights):
        raise ValueError("a weight is negative")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    scores = []
    for i, w in enumerate(weights):
        if w > 0:
            drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{i}:"), text).cast("binary")), 1, 13), 16, 10).cast("long")
            u = (drawn.cast("double") + 0.5) / float(2**52)
            scores.append(F.struct((F.lit(-float(w)) / F.ln(u)).alias("score"), F.lit(i).alias("shard")))
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard_rows(df: DataFrame, weights: Sequence[float], grown: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: key, size (UTF-8 bytes of the text plus 1; null text:
    1), text_crc32 (null text: that of no bytes, 0), shard, slot, grown_shard.

    Slots of a shard run from 0 without gaps in the order of (md5 of key, size and
    checksum; key; size; checksum).  Equal rows are counted before the shuffle and
    expanded afterwards, so no repeated row weighs on one task; a shard is numbered in
    4096 buckets of that md5 whose offsets come from a table of at most 4096 rows a shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "text_crc32")
    rows = rows.select("*", rendezvous(F.col("doc_id"), weights).alias("shard"), rendezvous(F.col("doc_id"), grown).alias("grown_shard"), F.md5(name.cast("binary")).alias("h"))
    rows = cut(rows.withColumn("bucket", F.substring("h", 1, SLOT_DIGITS)))
    counts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("m"))
    before = counts.select("shard", "bucket", (F.sum("m").over(W.partitionBy("shard").orderBy("bucket")) - F.col("m")).alias("offset"))
    # at most 4096 rows a shard, whatever the input
    rows = rows.join(F.broadcast(before), ["shard", "bucket"])
    own = W.partitionBy("shard", "bucket").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("first", F.col("offset") + F.sum("n").over(own) - F.col("n"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("i")).alias("slot"), "grown_shard")

