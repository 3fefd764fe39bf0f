"""A broken time axis, a line's segments on it, and positions of times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params


def build(points: DataFrame, keys: list[str], t: str, params: Params = DEFAULTS) -> DataFrame:
    """(keys, block, t0, t1, x0, x1, degraded): blocks of an axis of width 100 for each key.

    The axis breaks where neighbouring points lie further apart than a share of the whole span.
    Breaks have a fixed width and blocks a least one; what is left is shared by span.  Too many
    blocks narrow the breaks, and if that isn't enough there is one block of even scale.
    """
    w = W.partitionBy(*keys)
    order = w.orderBy(t)
    pts = points.where(F.col(t).isNotNull()).select(*keys, t).distinct()
    pts = pts.withColumns({"lo": F.min(t).over(w), "hi": F.max(t).over(w), "gap": F.col(t) - F.lag(t).over(order)})
    cut = F.coalesce((F.col("gap") > (F.col("hi") - F.col("lo")) * params.axis_break_share), F.lit(False))
    pts = pts.withColumn("block", F.sum(cut.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    blocks = pts.groupBy(*keys, "block", "lo", "hi").agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    blocks = blocks.withColumns({"n": F.count("*").over(w), "total": F.sum(F.col("t1") - F.col("t0")).over(w)})
    least, breaks, wide = 100 * params.axis_min_width, F.col("n") - 1, 100 * params.axis_break_width
    narrow = F.greatest(F.lit(1.0), F.greatest(F.lit(0.0), 100 - F.col("n") * least) * 0.4 / breaks)
    blocks = blocks.withColumn("bw", F.when(breaks == 0, 0.0).when(breaks * wide + F.col("n") * least >= 100, narrow).otherwise(wide))
    blocks = blocks.withColumn("degraded", (F.col("n") > 1) & (breaks * F.col("bw") + F.col("n") * least >= 100))
    left = 100 - breaks * F.col("bw") - F.col("n") * least
    width = least + F.when(F.col("total") > 0, (F.col("t1") - F.col("t0")) / F.col("total") * left).otherwise(left / F.col("n"))
    run = w.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("w", width)
    x0 = F.coalesce(F.sum("w").over(run), F.lit(0.0)) + F.col("block") * F.col("bw")
    blocks = blocks.withColumn("x0", x0).withColumn("x1", F.when(F.col("block") == F.col("n") - 1, 100.0).otherwise(F.col("x0") + F.col("w")))
    whole = F.col("degraded")
    out = blocks.where(~whole | (F.col("block") == 0))
    return out.select(*keys, F.col("block").cast("long").alias("block"), F.when(whole, F.col("lo")).otherwise(F.col("t0")).alias("t0"), F.when(whole, F.col("hi")).otherwise(F.col("t1")).alias("t1"), F.when(whole, 0.0).otherwise(F.col("x0")).alias("x0"), F.when(whole, 100.0).otherwise(F.col("x1")).alias("x1"), "degraded")


def position(t: Column, t0: Column, t1: Column, x0: Column, x1: Column) -> Column:
    """Where a time of a block stands; a block of one moment puts it in its middle."""
    return F.when(t1 == t0, (x0 + x1) / 2).otherwise(x0 + (t - t0) / (t1 - t0) * (x1 - x0))


def lane_segments(points: DataFrame, blocks: DataFrame, keys: list[str], lane: str, t: str, params: Params = DEFAULTS) -> DataFrame:
    """(keys, lane, block, t0, t1, x0, x1): a lane's extent in each block, at least a little wide and
    never outside the block; a block of one moment is filled."""
    b = blocks.select(*keys, "block", F.col("t0").alias("b0"), F.col("t1").alias("b1"), F.col("x0").alias("c0"), F.col("x1").alias("c1"))
    inside = points.where(F.col(t).isNotNull()).join(b, keys).where((F.col(t) >= F.col("b0")) & (F.col(t) <= F.col("b1")))
    segs = inside.groupBy(*keys, lane, "block", "b0", "b1", "c0", "c1").agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    at = lambda c: position(F.col(c), F.col("b0"), F.col("b1"), F.col("c0"), F.col("c1"))
    segs = segs.withColumns({"p0": at("t0"), "p1": at("t1")})
    least = params.segment_min_width
    thin = F.col("p1") - F.col("p0") < least
    start = F.least(F.greatest(F.col("c0"), (F.col("p0") + F.col("p1")) / 2 - least / 2), F.col("c1") - least)
    moment = F.col("b0") == F.col("b1")
    x0 = F.when(moment, F.col("c0")).when(thin, start).otherwise(F.col("p0"))
    x1 = F.when(moment, F.col("c1")).when(thin, start + least).otherwise(F.col("p1"))
    return segs.select(*keys, lane, "block", "t0", "t1", x0.alias("x0"), x1.alias("x1"))


def gap_times(gaps: DataFrame, times: DataFrame) -> DataFrame:
    """gaps with t: that of ``before``, else of ``after``, else null.  times: scene, t (aligned lines only)."""
    b, a = times.select(F.col("scene").alias("before"), F.col("t").alias("tb")), times.select(F.col("scene").alias("after"), F.col("t").alias("ta"))
    return gaps.join(b, "before", "left").join(a, "after", "left").withColumn("t", F.coalesce("tb", "ta")).drop("tb", "ta")
