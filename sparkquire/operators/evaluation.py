"""Figures against known truth: recall of planted versions, names, contradictions and time conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dedup_recall(groups: DataFrame, planted: DataFrame) -> DataFrame:
    """(kind, planted, found, recall) and a row of null kind for all.  groups: group, id; planted: kind,
    variant, original: found if some scene of either share a group.  scenes are joined by id."""
    a, b = groups.select(F.col("group").alias("g"), F.col("id").alias("variant")), groups.select(F.col("group").alias("g"), F.col("id").alias("original"))
    hit = planted.join(a, "variant").join(b, ["g", "original"]).select("kind", "variant").distinct().withColumn("hit", F.lit(1))
    both = planted.select("kind", "variant").distinct().join(hit, ["kind", "variant"], "left")
    return both.rollup("kind").agg(F.count("*").alias("planted"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def group_sizes(groups: DataFrame) -> DataFrame:
    """(groups, members, smallest, median, largest), one row."""
    n = groups.groupBy("group").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("groups"), F.sum("n").alias("members"), F.min("n").alias("smallest"), F.median("n").alias("median"), F.max("n").alias("largest"))


def main_entity(names: DataFrame, entity_of: DataFrame) -> DataFrame:
    """(key, entity): the entity that most of a key's names are of, of equals the first named.
    names: key, name, no; entity_of: name, entity."""
    found = names.join(entity_of, "name").groupBy("key", "entity").agg(F.count("*").alias("n"), F.min("no").alias("no"))
    return found.groupBy("key").agg(F.min_by("entity", F.struct(-F.col("n"), F.col("no"))).alias("entity"))


def alias_recall(pairs: DataFrame, entity_of: DataFrame) -> DataFrame:
    """(pairs, found, recall), one row: pairs (a, b) of names of one person that are in one entity."""
    x, y = entity_of.select(F.col("name").alias("a"), F.col("entity").alias("ea")), entity_of.select(F.col("name").alias("b"), F.col("entity").alias("eb"))
    both = pairs.join(x, "a", "left").join(y, "b", "left")
    hit = F.count_if(F.col("ea") == F.col("eb"))
    return both.agg(F.count("*").alias("pairs"), hit.alias("found"), F.round(hit / F.count("*"), 6).alias("recall"))


def contradiction_recall(planted: DataFrame, values: DataFrame) -> DataFrame:
    """(no, hit): a planted pair of scenes is hit if one group has both, on different values.
    planted: no, scene_a, scene_b (any of several rows); values: group, value, scene."""
    a = values.select("group", F.col("value").alias("va"), F.col("scene").alias("scene_a"))
    b = values.select("group", F.col("value").alias("vb"), F.col("scene").alias("scene_b"))
    hit = planted.join(a, "scene_a").join(b, ["group", "scene_b"]).where("va <> vb").select("no").distinct().withColumn("hit", F.lit(True))
    return planted.select("no").distinct().join(hit, "no", "left").select("no", F.coalesce("hit", F.lit(False)).alias("hit"))


def timeline_recall(planted: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(kind, planted, found): planted (kind, no, who, scene_a, scene_b) against conflicts (kind, who,
    scene_a, scene_b); a null who fits any."""
    c = conflicts.select("kind", F.col("who").alias("w"), "scene_a", "scene_b")
    hit = planted.join(c, ["kind", "scene_a", "scene_b"]).where("who is null or w is null or who = w").select("kind", "no").distinct().withColumn("hit", F.lit(1))
    return planted.select("kind", "no").distinct().join(hit, ["kind", "no"], "left").groupBy("kind").agg(F.count("*").alias("planted"), F.count("hit").alias("found"))


def weighted_mean(rows: DataFrame, value: str, weight: str) -> DataFrame:
    """(mean), one row, nulls left out."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return rows.agg(F.round(F.sum(F.col(value) * w) / F.sum(w), 6).alias("mean"))


def precision_recall(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(tp, fp, fn, precision, recall), one row, of 0/1 columns."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    tp, fp, fn = F.count_if(t & g), F.count_if(~t & g), F.count_if(t & ~g)
    return rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(F.try_divide(tp, tp + fp), 6).alias("precision"), F.round(F.try_divide(tp, tp + fn), 6).alias("recall"))


def cost_estimate(steps: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """(step, calls, cost).  steps: step, items, per_call, tokens_in, tokens_out (of a call)."""
    calls = F.ceil(F.col("items") / F.col("per_call"))
    return steps.select("step", calls.alias("calls"), F.round((calls * F.col("tokens_in") * price_in + calls * F.col("tokens_out") * price_out) / 1e6, 6).alias("cost"))


def review_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows by a hash of their content and the seed: the same for the same rows, whatever their order."""
    return rows.withColumn("_h", F.xxhash64(F.lit(seed), *rows.columns)).orderBy("_h").limit(n).drop("_h")


def scene_positions(scenes: DataFrame, files: DataFrame) -> DataFrame:
    """(scene, chapter, piece, index) of scenes (scene, source, index) by the answer key's files (source, chapter, piece)."""
    return scenes.join(files, "source").select("scene", "chapter", "piece", "index")


def order_truth(rows: DataFrame) -> DataFrame:
    """rows (line, scene, pos, chapter, piece, index) with the rank that the truth gives them."""
    return rows.withColumn("truth", F.dense_rank().over(W.partitionBy("line").orderBy("chapter", "piece", "index")))
