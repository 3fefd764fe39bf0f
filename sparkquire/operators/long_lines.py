"""Long lines ordered in two levels: runs of neighbouring scenes go to volumes, a volume's scenes are
ordered on their own, and the volumes are laid end to end on one time axis.

A volume is what one task orders; a line of any length spreads over as many tasks as it has volumes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import natural_text
from ..params import DEFAULTS
from ..storage import cut
from .threads import agreement, consensus, segments, volume_offsets, volume_vote

Judged = Callable[[DataFrame], DataFrame]


def volume_counts(scenes: DataFrame, target: int = DEFAULTS.line_volume_scenes) -> DataFrame:
    """(line, n, least, most): how many volumes a line of its size should have, and the bounds of what is accepted."""
    n = F.ceil(F.count("*") / target).cast("long")
    return scenes.groupBy("line").agg(n.alias("n")).select("line", "n", F.greatest(F.lit(2), F.floor(F.col("n") / 2)).alias("least"), F.greatest(F.lit(2), 2 * F.col("n")).alias("most"))


def into_volumes(scenes: DataFrame, volumes: DataFrame, assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(line, volume, place, scene, segment, index) and the scenes (line, scene) that no volume takes.

    scenes: line, scene, source, index; volumes: line, volume, place; assigned: line, scene, volume.  A run of
    neighbouring scenes is never parted: it goes where most of its scenes were put, of equals to the earliest volume;
    a run of which no scene was put anywhere is left over, unknown volumes count as nowhere."""
    runs = segments(scenes.select("line", "scene", "source", "index"), ["line"])
    put = assigned.join(volumes, ["line", "volume"]).select("line", "scene", "volume", "place").distinct()
    votes = runs.join(put, ["line", "scene"]).select(F.struct("line", "segment").alias("segment"), "volume", "place")
    of = volume_vote(votes).select("segment.line", "segment.segment", "volume").join(volumes.select("line", "volume", "place"), ["line", "volume"])
    rows = runs.join(of, ["line", "segment"], "left")
    return rows.where("volume is not null").select("line", "volume", "place", "scene", "source", "segment", "index"), rows.where("volume is null").select("line", "scene")


def within_volumes(members: DataFrame, judged: DataFrame) -> DataFrame:
    """(line, volume, place, scene, pos, t): each volume's scenes in the order its passes agree on.

    members as from ``into_volumes``; judged: line, volume, pass, scene, pos, t (times from the volume's beginning).  Times are those
    of the pass that agrees best with that order, of equals the first.  A volume without any pass keeps the order in
    which its runs stand, without times; a scene that no pass places is left out."""
    name = F.to_json(F.struct(F.col("line").alias("l"), F.col("volume").alias("v")))
    members = members.withColumn("sub", name)
    passes = judged.join(members.select("line", "volume", "scene", "sub"), ["line", "volume", "scene"]).select(F.col("sub").alias("line"), "pass", "scene", "pos", "t")
    order = cut(consensus(passes.drop("t")))
    each = passes.withColumn("of", F.col("line")).withColumn("line", F.to_json(F.struct("line", "pass")))
    other = each.select("line", "of").distinct().join(order.withColumnRenamed("line", "of"), "of").drop("of")
    rated = agreement(each.select("line", "scene", "pos"), other).join(each.select("line", "of", "pass").distinct(), "line")
    best = rated.groupBy(F.col("of").alias("line")).agg(F.min_by("pass", F.struct(-F.col("agreement"), F.col("pass"))).alias("pass"))
    timed = passes.join(best, ["line", "pass"]).select(F.col("line").alias("sub"), "scene", "t")
    order = order.withColumnRenamed("line", "sub")
    found = members.join(order, ["sub", "scene"]).join(timed, ["sub", "scene"], "left").select("line", "volume", "place", "scene", "pos", "t")
    silent = members.join(order.select("sub").distinct(), "sub", "left_anti")
    own = W.partitionBy("line", "volume").orderBy("segment", "index", natural_text(F.col("scene").cast("string")))
    silent = silent.select("line", "volume", "place", "scene", (F.row_number().over(own) - 1).cast("long").alias("pos"), F.lit(None).cast("double").alias("t"))
    return found.unionByName(silent)


def end_to_end(ordered: DataFrame) -> DataFrame:
    """(line, scene, volume, pos, t): one line of its volumes' scenes, a volume's times behind the latest times of those before."""
    sizes = ordered.groupBy("line", "volume", "place").agg(F.count("*").alias("n"), F.max("t").alias("t_max"))
    shifts = volume_offsets(sizes.select("line", F.col("place").alias("volume"), "t_max")).select("line", F.col("volume").alias("place"), "shift")
    before = W.partitionBy("line").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    ahead = sizes.select("line", "place", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")).join(shifts, ["line", "place"])
    return ordered.join(ahead, ["line", "place"]).select("line", "scene", "volume", (F.col("ahead") + F.col("pos")).cast("long").alias("pos"), (F.col("t") + F.col("shift")).alias("t"))


def order_long_lines(scenes: DataFrame, volumes: DataFrame, assigned: DataFrame, judge: Judged) -> tuple[DataFrame, DataFrame]:
    """(line, scene, volume, pos, t) and the scenes (line, scene) that are left over.  ``judge`` takes the members of all
    volumes (``into_volumes``) and gives its passes over them (``within_volumes``)."""
    members, lost = into_volumes(scenes, volumes, assigned)
    members = cut(members)
    ordered = cut(within_volumes(members, judge(members)))
    missed = members.join(ordered, ["line", "volume", "scene"], "left_anti").select("line", "scene")
    return end_to_end(ordered), lost.unionByName(missed)
