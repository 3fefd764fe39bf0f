"""Many ordered lines merged into one sequence, window by window of the time base, as a judge orders them.

Every line keeps its own order whatever the judge says: it keeps the slots that it was given, filled with
its scenes in their order.  Scenes that the judge left out follow the named one before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..params import DEFAULTS
from ..storage import cut
from .numbering import numbered


def windowed(base: DataFrame, most: int = DEFAULTS.order_window) -> DataFrame:
    """(window, line, scene, place): the time base (line, scene, place; places 1, 2 and on) in windows of ``most`` scenes at most,
    as few as can be and of sizes that differ by one, by arithmetic on the places alone."""
    n = base.count()
    if not n:
        return base.select(F.lit(0).cast("long").alias("window"), "line", "scene", "place")
    k = -(-n // most)
    size, longer = n // k, n % k * (n // k + 1)
    p = F.col("place") - 1
    window = F.when(p < longer, F.floor(p / (size + 1))).otherwise(n % k + F.floor((p - longer) / size))
    return base.select((window + 1).cast("long").alias("window"), "line", "scene", "place")


def faults(members: DataFrame, judged: DataFrame) -> DataFrame:
    """(window, scenes, named, repeated, unknown, broken): of each window's judged order.  named: different scenes of the
    window in it; repeated: further mentions of them; unknown: entries that aren't of the window; broken: lines whose order it breaks."""
    known = judged.join(members.select("window", "scene", "line", "place"), ["window", "scene"], "left")
    first = known.where("line is not null").groupBy("window", "scene", "line", "place").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    step = W.partitionBy("window", "line").orderBy("place")
    falls = first.withColumn("falls", F.coalesce(F.lag("rank").over(step) > F.col("rank"), F.lit(False)))
    lines = falls.groupBy("window", "line").agg(F.max("falls").alias("broken"), F.count("*").alias("named"), F.sum(F.col("n") - 1).alias("repeated"))
    lines = lines.groupBy("window").agg(F.count_if("broken").alias("broken"), F.sum("named").alias("named"), F.sum("repeated").alias("repeated"))
    strange = known.where("line is null").groupBy("window").agg(F.count("*").alias("unknown"))
    size = members.groupBy("window").agg(F.count("*").alias("scenes"))
    rows = size.join(lines, "window", "left").join(strange, "window", "left")
    return rows.select("window", "scenes", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("named", "repeated", "unknown", "broken")))


def damage(found: DataFrame) -> DataFrame:
    """(window, damage): a repeat or an unknown scene 1, a missing one 3, a broken line 5."""
    return found.select("window", (F.col("repeated") + F.col("unknown") + 3 * (F.col("scenes") - F.col("named")) + 5 * F.col("broken")).alias("damage"))


def interleaved(members: DataFrame, judged: DataFrame, share: float = DEFAULTS.placed_share) -> DataFrame:
    """(line, scene, place): one valid merge, places 1, 2 and on over all windows.

    members: as from ``windowed``; judged: window, scene, rank.  A window's entry counts where it first stands; unknown ones go.  A window in
    which fewer than ``share`` of the scenes are named, or whose scenes are of one line, keeps the time base's order.

    A line's scenes in a window are cut into blocks, each a named scene with the unnamed ones behind it (the first block has
    those before it too); the line's k-th slot takes its k-th block, and lines that aren't named stand at the window's end."""
    first = judged.groupBy("window", "scene").agg(F.min("rank").alias("rank"))
    rows = members.join(first, ["window", "scene"], "left")
    whole = W.partitionBy("window")
    lines = F.size(F.collect_set("line").over(whole))
    rows = rows.withColumn("judged", (F.count("rank").over(whole) >= share * F.count("*").over(whole)) & (lines > 1))
    rows = rows.withColumn("rank", F.when(F.col("judged"), F.col("rank")))
    rows = cut(rows.select("window", "line", "scene", "place", "rank", "judged"))
    line = W.partitionBy("window", "line")
    block = F.greatest(F.lit(1), F.count("rank").over(line.orderBy("place").rowsBetween(W.unboundedPreceding, 0)))
    slots = rows.where("rank is not null").select("window", "line", F.col("rank").alias("slot"), F.row_number().over(line.orderBy("rank")).alias("block"))
    placed = rows.withColumn("block", block).withColumn("head", F.min("place").over(line)).join(slots, ["window", "line", "block"], "left")
    # a window that keeps its order needs no slot; a line without a slot stands behind those with one
    late = F.when(F.col("judged"), F.when(F.col("slot").isNull(), F.col("head")))
    keys = placed.select("line", "scene", "window", F.col("slot").isNull().cast("int").alias("_late"), F.coalesce("slot", F.lit(0)).alias("_slot"), F.coalesce(late, F.lit(0)).alias("_head"), F.col("place").alias("_at"))
    return numbered(keys, ["window", "_late", "_slot", "_head", "_at"], "place").select("line", "scene", "place")


def interleave_book(base: DataFrame, judge, most: int = DEFAULTS.order_window, share: float = DEFAULTS.placed_share) -> DataFrame:
    """(line, scene, place): the time base re-ordered window by window by ``judge`` (members to window, scene, rank)."""
    members = cut(windowed(base, most))
    return interleaved(members, judge(members), share)
