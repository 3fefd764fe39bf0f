"""Connected components by alternating large-star and small-star steps, in DataFrame
operations only.  A step deals the edges out once, by node, and reads each node's neighbours
in order: the first is the least, and repeats stand side by side.  An edge stays one row, so
nothing else is shuffled.  A hub's edges are one sorted run, which Spark may spill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, release


def _near(edges: DataFrame) -> DataFrame:
    """edges (u, v), v the candidates of u: each once, with the least of its u as ``least``."""
    by_node = Window.partitionBy("u").orderBy("v")
    near = edges.select("u", "v", F.first("v").over(by_node).alias("least"), F.lag("v").over(by_node).alias("before"))
    return near.where(~F.col("v").eqNullSafe(F.col("before"))).drop("before")


def _large(edges: DataFrame, judged: bool = False) -> DataFrame:
    """edges point down (v < u); afterwards each node points to the least neighbours of its lower ones.  If ``judged``, rows that
    keep the given edges from being stars around least nodes are ``loose``; those of no edge have a null u."""
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("way")
    near = _near(edges.select(ways).select("way.u", "way.v"))
    ahead, least = F.expr("if(v > u, v, null)").alias("u"), F.least("u", "least").alias("v")
    if not judged:
        return near.where("v > u").select(ahead, least)
    # in stars a node with a lower neighbour has no other one
    return near.select(ahead, least, F.expr("least < u and v <> least").alias("loose")).where("u is not null or loose")


def _small(edges: DataFrame) -> DataFrame:
    """edges point down (v < u); afterwards each node and its other lower ones point to the least of its lower ones."""
    return _near(edges).select(F.expr("if(v = least, u, v)").alias("u"), F.col("least").alias("v"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): for every node of an edge the least node that links reach.

    Edges may repeat, run both ways, be loops or hold nulls (dropped); no edges give no
    rows.  Every second round is checkpointed; the driver sees only whether any edge is loose.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = cut(e.distinct())
    loops = e.where("u = v").select("u", "v")
    e = e.where("u <> v")
    if not e.isEmpty():
        e = _large(e)
        for _ in range(0, rounds, 2):
            found = cut(_large(_small(_large(_small(e))), judged=True))
            e = found.where("u is not null").select("u", "v")
            if found.where("loose").isEmpty():
                break
            release(edges.sparkSession)  # the shuffles and checkpoint of the rounds before
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(roots.union(alone)).groupBy("node").agg(F.min("component").alias("component"))
