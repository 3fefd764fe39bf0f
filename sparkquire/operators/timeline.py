"""Conflicts of time: the dead who appear again, references ahead of what they refer to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import one_line, padded, signature
from ..params import DEFAULTS, Params
from ..storage import cut
from .numbering import numbered
from .search import naming

#: Words that tell of a death, words that tell it isn't one, attributes that may tell.
DEATH_WORDS = ("死", "亡", "殁", "歿", "卒", "身故", "病故", "已故", "归天", "歸天", "逝", "阵亡", "陣亡", "斩", "斬", "枭首", "梟首", "丧命", "喪命", "殒命", "殞命", "去世", "坐化")
NOT_DEATH = ("免死", "未死", "不死", "没死", "沒死", "幾乎", "几乎", "险些", "險些", "差点", "差點", "被擒", "监禁", "監禁", "车囚", "車囚", "丁艱", "丁艰", "生还", "生還", "得救", "亡命", "视死", "視死", "死战", "死戰", "死守", "士卒", "兵卒", "狱卒", "獄卒", "走卒", "死囚", "逃亡", "诈死", "詐死", "假死", "死活", "生死不明", "存亡未卜")
DEATH_ATTRIBUTES = ("生死", "身份", "其他", "伤病", "結局", "结局")


def is_death(attribute: Column, value: Column) -> Column:
    v = F.btrim(F.coalesce(value, F.lit("")))
    known = F.btrim(F.coalesce(attribute, F.lit(""))).isin(*DEATH_ATTRIBUTES)
    return known & (v != "") & ~v.rlike("|".join(NOT_DEATH)) & v.rlike("|".join(DEATH_WORDS))


def is_killer(value: Column, names: Column) -> Column:
    """Whether any of the names stands in the value as the one who acts."""
    n = lambda before, x, after: F.contains(value, F.concat(F.lit(before), x, F.lit(after)))
    acts = (("于", ""), ("被", ""), ("", "之手"), ("", "所"), ("", "杀"), ("", "击"), ("", "斩"))
    return F.exists(names, lambda x: (x != "") & reduce(lambda a, b: a | b, (n(p, x, q) for p, q in acts)))


def first_deaths(facts: DataFrame, order: DataFrame, names: DataFrame) -> DataFrame:
    """(who, scene, pos, quote): each person's first death in story order, killers' rows aside.
    facts: scene, who (canonical), attribute, value, quote, no; order: scene, pos; names: name, who."""
    aliases = names.groupBy("who").agg(F.collect_set("name").alias("aliases"))
    rows = facts.where(is_death(F.col("attribute"), F.col("value")) & (F.col("who") != "")).join(order, "scene").join(aliases, "who", "left")
    rows = rows.where(~is_killer(F.col("value"), F.concat(F.array("who"), F.coalesce("aliases", F.array().cast("array<string>")))))
    return rows.groupBy("who").agg(F.min(F.struct("pos", "no", "scene", F.coalesce(F.nullif("quote", F.lit("")), "value").alias("quote"))).alias("x")).select("who", "x.scene", "x.pos", "x.quote")


def pick_later(rows: DataFrame, keys: list[str], order: str, n: int = DEFAULTS.death_later, near: int = DEFAULTS.death_near) -> DataFrame:
    """Of each key's rows in order: the first ``near``, and of the rest n - near spread evenly."""
    w = W.partitionBy(*keys)
    rows = rows.withColumns({"_r": F.row_number().over(w.orderBy(order)) - 1, "_m": F.count("*").over(w)})
    k, rest = n - near, F.col("_m") - near
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: near + F.floor((i + 0.5) * rest / k))
    kept = (F.col("_m") <= n) | (F.col("_r") < near) | F.array_contains(at, F.col("_r").cast("long"))
    return rows.where(kept).drop("_r", "_m")


def death_suspects(deaths: DataFrame, people: DataFrame, order: DataFrame, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(who, death, later, pos): scenes after a person's death in which they appear, a few for each;
    and (who, capped): how many were left out.  people: scene, who."""
    d = deaths.select("who", F.col("scene").alias("death"), F.col("pos").alias("died"))
    later = people.select("scene", "who").distinct().join(order, "scene").join(d, "who").where("pos > died").select("who", "death", "died", F.col("scene").alias("later"), "pos")
    capped = later.groupBy("who").agg((F.count("*") - params.death_later).alias("capped")).where("capped > 0")
    return pick_later(later, ["who"], "pos", params.death_later, params.death_near), capped


def bigrams(rows: DataFrame, text: str, keep: str = "一-鿿") -> DataFrame:
    """rows' id with each distinct pair of neighbouring characters of a class (Han by default)."""
    runs = F.regexp_extract_all(text, F.lit(f"([{keep}]{{2,}})"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    return rows.select("id", F.explode(F.array_distinct(pairs)).alias("bigram"))


def rare_bigrams(pairs: DataFrame, scenes: int, share: float = DEFAULTS.common_bigram_share) -> DataFrame:
    """Bigram rows without those in more than ``share`` of all scenes."""
    common = pairs.groupBy("bigram").agg(F.count_distinct("id").alias("df")).where(F.col("df") > share * scenes).select("bigram")
    return pairs.join(common, "bigram", "left_anti")


#: References by person that are broadcast; beyond, scenes are shuffled to meet them.
BROADCAST_REFS = 100_000


def ref_candidates(refs: DataFrame, people: DataFrame, order: DataFrame, bigram_rows: DataFrame, aliases: DataFrame, picks: DataFrame | None = None, params: Params = DEFAULTS, keep: str = "一-鿿") -> DataFrame:
    """(scene, ref, candidate, r): scenes that a reference may mean, best first.

    A candidate holds a person the reference names, or two persons of its scene.  Picks by a judge come
    first; then named ones, more rare bigrams of the reference in the scene, more persons in
    common, the same line, nearer, earlier.  refs: scene, ref; people: scene, who; order: scene,
    pos, line; bigram_rows: id, bigram (rare ones); aliases: name, who.  Scenes carry their persons and bigrams to where
    they meet a reference by one person; of a pair's persons the least one counts it, whole.
    """
    ref_id = refs.select("scene", "ref").distinct().withColumn("id", F.xxhash64("scene", "ref"))
    cast = people.where("who is not null").select("scene", "who").distinct()
    kind = f"array<{people.schema['who'].dataType.simpleString()}>"
    held = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    named = naming(ref_id, "ref", aliases, "name").groupBy("id").agg(F.collect_set("who").cast(kind).alias("names"))
    # two persons in common are never the commonest of the scene's alone: that one brings no candidate, so a hero of all scenes joins with none
    often = cast.groupBy("who").agg(F.count("*").alias("df"))
    mine = ref_id.select("scene").distinct().join(cast, "scene").join(often, "who").groupBy("scene").agg(F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("df"), "who")))["who"].alias("mine"))
    terms = lambda rows, of: rows.groupBy(F.col("id").alias(of)).agg(F.collect_set(F.xxhash64("bigram")).alias(f"{of}_terms"))
    asked = ref_id.join(order.select("scene", F.col("pos").alias("p0"), F.col("line").alias("l0")), "scene")
    asked = asked.join(mine, "scene", "left").join(named, "id", "left").join(terms(bigrams(ref_id.select("id", "ref"), "ref", keep), "id"), "id", "left")
    asked = asked.select("id", "scene", "ref", "p0", "l0", held("mine", kind), held("names", kind), held("id_terms", "array<bigint>"))
    there = order.select(F.col("scene").alias("candidate"), F.col("pos").alias("p1"), F.col("line").alias("l1"))
    shown = ("id", "scene", "ref", "candidate", "p0", "l0", "p1", "l1")
    chosen = None
    if picks is not None:
        first = F.row_number().over(W.partitionBy("id").orderBy("picked"))
        chosen = cut(picks.join(asked.select("id", "scene", "ref", "p0", "l0"), ["scene", "ref"]).join(there, "candidate").select(*shown, "picked").withColumn("r", first).where(F.col("r") <= params.ref_candidates).drop("r"))
        # a reference whose picks take all places is compared with nothing
        asked = asked.join(chosen.groupBy("id").agg(F.collect_set("candidate").alias("chosen")), "id", "left").where(F.coalesce(F.size("chosen"), F.lit(0)) < params.ref_candidates)
    asked = cut(asked.withColumn("keys", F.array_distinct(F.concat(F.slice("mine", F.lit(2), F.greatest(F.size("mine") - 1, F.lit(0))), "names"))).withColumn("who", F.explode("keys")))
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_REFS else asked
    scenes = cast.groupBy(F.col("scene").alias("candidate")).agg(F.collect_set("who").alias("whos")).join(there, "candidate").join(terms(bigram_rows, "id").withColumnsRenamed({"id": "candidate", "id_terms": "terms"}), "candidate", "left")
    # a pair is counted in full where it meets, once, so that none is shuffled but the best
    both = scenes.withColumn("who", F.explode("whos")).join(asked, "who").where("scene <> candidate").where(F.col("who") == F.array_min(F.array_intersect("keys", "whos")))
    if picks is not None:
        both = both.where(~F.coalesce(F.array_contains("chosen", F.col("candidate")), F.lit(False)))
    both = both.withColumns({"named": F.arrays_overlap("names", "whos").cast("int"), "shared": F.size(F.array_intersect("mine", "whos")), "picked": F.lit(None).cast("int")}).where("named = 1 or shared >= 2")
    both = both.select(*shown, "picked", "named", "shared", F.size(F.array_intersect("id_terms", F.coalesce("terms", F.array().cast("array<bigint>")))).alias("overlap"))
    if chosen is not None:
        both = both.unionByName(chosen, allowMissingColumns=True)
    best = W.partitionBy("id").orderBy(F.col("picked").asc_nulls_last(), F.desc("named"), F.coalesce("overlap", F.lit(0)).desc(), F.desc("shared"), (~F.col("l0").eqNullSafe(F.col("l1"))).cast("int"), F.abs(F.col("p0") - F.col("p1")), "p1")
    return both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= params.ref_candidates).select("scene", "ref", "candidate", "r", "p0", "p1")


def ref_outcomes(refs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(scene, ref, outcome): ask, no_candidate, or all_before if every candidate comes earlier."""
    found = candidates.groupBy("scene", "ref").agg(F.bool_and(F.col("p1") < F.col("p0")).alias("before"))
    return refs.select("scene", "ref").distinct().join(found, ["scene", "ref"], "left").select("scene", "ref", F.when(F.col("before").isNull(), "no_candidate").when(F.col("before"), "all_before").otherwise("ask").alias("outcome"))


def index_line(scene: Column, summary: Column, chars: int = DEFAULTS.index_line_chars) -> Column:
    return F.concat(F.lit("["), scene, F.lit("] "), F.substr(one_line(summary), F.lit(1), F.lit(chars)))


def conflict_signature(kind: Column, who: Column, ref: Column, scenes: Column) -> Column:
    return signature(kind, who, ref, F.array_join(scenes, "\x1f"), digits=16)


def carry_ids(conflicts: DataFrame, registry: DataFrame, verdicts: DataFrame, prefix: str = "T-") -> DataFrame:
    """conflicts (sig, no, ...) with the id and verdict that their signature had; new ones are numbered
    after the largest id ever given.  registry: sig, id, and ``number`` where an id doesn't hold its number whole; verdicts: sig, verdict."""
    once = conflicts.withColumn("_r", F.row_number().over(W.partitionBy("sig").orderBy("no"))).where("_r = 1").drop("_r")
    number = F.col("number") if "number" in registry.columns else F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    top = registry.agg(F.coalesce(F.max(number), F.lit(0)).alias("top"))
    known = once.join(registry.select("sig", "id"), "sig", "left")
    fresh = numbered(known.where("id is null").select("sig", "no"), ["no", "sig"], "k").crossJoin(F.broadcast(top))  # ``top`` is one row
    fresh = fresh.select("sig", F.concat(F.lit(prefix), padded(F.col("top") + F.col("k"), 3)).alias("new_id"))
    known = known.join(fresh, "sig", "left").withColumn("id", F.coalesce("id", "new_id")).drop("new_id")
    return known.join(verdicts.select("sig", "verdict"), "sig", "left")
