"""The board of lines (keep, merge, cut, undecided), their figures, and what cutting one touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import natural_text
from .search import naming
from .entities import PRONOUNS

COLUMNS = ("keep", "merge", "cut", "undecided")
STRONG_ROLES = ("主要", "次要")


def reconcile(board: DataFrame, threads: DataFrame) -> DataFrame:
    """(thread, col, merge_into, note, orphan, merge_invalid): every line has a card, cards without a
    line are orphans; a merge is invalid into itself, into no line, or into one cut or merged.
    board: thread, col, merge_into, note; threads: thread."""
    cards = board.select("thread", F.when(F.col("col").isin(*COLUMNS), F.col("col")).otherwise("undecided").alias("col"), "merge_into", F.coalesce("note", F.lit("")).alias("note"))
    both = threads.select("thread", F.lit(True).alias("live")).join(cards, "thread", "full")
    both = both.select("thread", F.coalesce("col", F.lit("undecided")).alias("col"), F.when(F.col("col") == "merge", F.col("merge_into")).alias("merge_into"), F.coalesce("note", F.lit("")).alias("note"), F.col("live").isNull().alias("orphan"))
    target = both.where("not orphan").select(F.col("thread").alias("merge_into"), F.col("col").alias("into_col"))
    known = both.join(target, "merge_into", "left")
    wrong = F.col("into_col").isNull() | F.col("into_col").isin("cut", "merge") | (F.col("merge_into") == F.col("thread"))
    return known.select("thread", "col", "merge_into", "note", "orphan", ((F.col("col") == "merge") & F.coalesce(wrong, F.lit(True))).alias("merge_invalid"))


def set_card(board: DataFrame, threads: DataFrame, thread: str, col: str, merge_into: str | None = None, note: str | None = None) -> DataFrame:
    """The board with one card set; merges may not chain."""
    if col not in COLUMNS:
        raise ValueError(f"a column is one of {', '.join(COLUMNS)}")
    state = {r.thread: r for r in reconcile(board, threads).where(F.col("thread").isin(thread, merge_into or thread) | (F.col("merge_into") == thread)).collect()}  # a few cards
    if thread not in state or state[thread].orphan:
        raise KeyError(thread)
    if col == "merge":
        into = state.get(merge_into)
        if merge_into == thread or into is None or into.orphan or into.col in ("cut", "merge"):
            raise ValueError("a merge needs another live line that is neither cut nor merged")
        if any(r.col == "merge" and r.merge_into == thread for r in state.values() if r.thread != thread):
            raise ValueError("another line is merged into this one")
    kept = state[thread].note if note is None else note
    new = board.sparkSession.createDataFrame([(thread, col, merge_into if col == "merge" else None, kept)], "thread string, col string, merge_into string, note string")
    return board.where(F.col("thread") != thread).select("thread", "col", "merge_into", "note").unionByName(new)


def delete_orphan(board: DataFrame, threads: DataFrame, thread: str) -> DataFrame:
    if not threads.where(F.col("thread") == thread).isEmpty():
        raise ValueError("the line is still there")
    return board.where(F.col("thread") != thread)


def thread_stats(members: DataFrame, scenes: DataFrame, gaps: DataFrame, dropped: DataFrame) -> DataFrame:
    """(thread, words, scenes, gaps): words count live main versions, scenes the list as it stands.
    members: thread, scene; scenes: scene, chars, removed; gaps: thread; dropped: scene."""
    live = scenes.where("not removed").join(dropped.select("scene"), "scene", "left_anti").select("scene", "chars")
    words = members.join(live, "scene", "left").groupBy("thread").agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("words"), F.count("*").alias("scenes"))
    n = gaps.where("thread is not null").groupBy("thread").agg(F.count("*").alias("gaps"))
    return words.join(n, "thread", "left").select("thread", "words", "scenes", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"))


def crossings(intersections: DataFrame, main: str) -> DataFrame:
    """(thread, other, scene, main_scene) seen from either side.  intersections: thread, scene, main_scene."""
    side = intersections.where("thread is not null").select("thread", F.lit(main).alias("other"), "scene", "main_scene")
    return side.union(side.select(F.col("other").alias("thread"), F.col("thread").alias("other"), "scene", "main_scene"))


def only_here(appearances: DataFrame) -> DataFrame:
    """(thread, name, scenes): canonical persons that appear in one line alone, with a strong role in
    it; scenes: in how many they have one.  appearances: thread, scene, name, role."""
    named = appearances.where((F.btrim("name") != "") & ~F.btrim("name").isin(*PRONOUNS))
    strong = F.when(F.col("role").isin(*STRONG_ROLES), F.col("scene"))
    found = named.groupBy("name").agg(F.min("thread").alias("thread"), F.max("thread").alias("last"), F.count_distinct(strong).alias("scenes"))
    return found.where("thread = last and scenes > 0").select("thread", "name", "scenes")


def maybe_refs(only: DataFrame, aliases: DataFrame, refs: DataFrame) -> DataFrame:
    """(thread, scene, other, text, name): references in other lines that name such a person by any
    alias.  aliases: name, alias; refs: thread, scene, text."""
    known = only.select("thread", "name").join(aliases, "name", "left").select("thread", "name", F.explode(F.array_distinct(F.array(F.coalesce("alias", "name"), "name"))).alias("alias"))
    texts = refs.select(F.col("thread").alias("other"), "scene", "text")
    hit = naming(texts, "text", known, "alias").where(F.col("thread") != F.col("other"))
    return hit.select("thread", "scene", "other", "text", "name").distinct()


def line_figures(stats: DataFrame) -> DataFrame:
    return stats.orderBy(natural_text(F.col("thread")))
