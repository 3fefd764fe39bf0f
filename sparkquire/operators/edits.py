"""Author's edits of lines and books, as rewrites of their rows.

Lines: header rows (id, world, name, about, status, ``offset``) and members (thread, pos, scene,
outline, t, conf).  Every edit returns both; ``tidy`` then drops what the edit emptied.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONFIRMED, DRAFT = "confirmed", "draft"


@dataclass(frozen=True)
class Book:
    threads: DataFrame  # id, world, name, about, status, offset
    members: DataFrame  # thread, pos, scene, outline, t, conf
    crossings: DataFrame  # thread, scene, main_scene
    gaps: DataFrame  # gap, thread, after, before
    pending: DataFrame  # scene, thread, reason
    unassigned: DataFrame  # scene, reason
    world_outlines: DataFrame  # world, scene
    main: str | None = None


def _touched(threads: DataFrame, ids: list[str]) -> DataFrame:
    """Lines that an author has edited count as confirmed."""
    return threads.withColumn("status", F.when(F.col("id").isin(*ids), CONFIRMED).otherwise(F.col("status")))


def _numbered(members: DataFrame, *order) -> DataFrame:
    """Places from 0 within a line, in an order."""
    return members.withColumn("pos", (F.row_number().over(W.partitionBy("thread", "outline").orderBy(*order)) - 1).cast("long"))


def _known(book: Book, ids: list[str]) -> None:
    found = {r.id for r in book.threads.where(F.col("id").isin(*ids)).select("id").collect()}
    if missing := set(ids) - found:
        raise KeyError(", ".join(sorted(missing)))


def tidy(book: Book) -> Book:
    """Lines without scenes go, their outlines to the world; the main line falls to the longest left;
    crossings and gaps keep only what is still there."""
    alive = book.members.where("not outline").select(F.col("thread").alias("id")).distinct()
    threads = book.threads.join(alive, "id", "left_semi")
    lost = book.members.where("outline").join(alive, F.col("thread") == F.col("id"), "left_anti").join(book.threads.select(F.col("id").alias("thread"), "world"), "thread").select("world", "scene")
    members = book.members.join(alive, F.col("thread") == F.col("id"), "left_semi")
    main = book.main
    if main is not None and threads.where(F.col("id") == main).isEmpty():
        longest = members.where("not outline").groupBy("thread").count().orderBy(F.desc("count"), "thread").first()
        main = longest.thread if longest else None
    inside = members.where("not outline").select("thread", "scene")
    crossings = book.crossings.where(F.col("thread") != F.lit(main)).join(inside, ["thread", "scene"], "left_semi")
    crossings = crossings.join(inside.where(F.col("thread") == F.lit(main)).select(F.col("scene").alias("main_scene")), "main_scene", "left_semi").select("thread", "scene", "main_scene")
    ends = inside.withColumn("ok", F.lit(True))
    a, b = ends.select("thread", F.col("scene").alias("after"), F.col("ok").alias("oa")), ends.select("thread", F.col("scene").alias("before"), F.col("ok").alias("ob"))
    live = threads.select(F.col("id").alias("thread"), F.lit(True).alias("live"))
    gaps = book.gaps.join(live, "thread", "left").join(a, ["thread", "after"], "left").join(b, ["thread", "before"], "left")
    gaps = gaps.select("gap", F.when(F.col("live"), F.col("thread")).alias("thread"), F.when(F.col("oa"), F.col("after")).alias("after"), F.when(F.col("ob"), F.col("before")).alias("before"))
    pending = book.pending.join(live.select("thread"), "thread", "left_semi").select("scene", "thread", "reason")
    moved = book.pending.join(live.select("thread"), "thread", "left_anti").select("scene", F.lit("its line is gone").alias("reason"))
    return replace(book, threads=threads, members=members, crossings=crossings, gaps=gaps, pending=pending, unassigned=book.unassigned.select("scene", "reason").union(moved), world_outlines=book.world_outlines.union(lost).distinct(), main=main)


def confirm(book: Book, ids: list[str]) -> Book:
    _known(book, ids)
    return replace(book, threads=_touched(book.threads, ids))


def rename(book: Book, thread: str, name: str) -> Book:
    if not name.strip():
        raise ValueError("a name can't be empty")
    _known(book, [thread])
    return replace(book, threads=_touched(book.threads.withColumn("name", F.when(F.col("id") == thread, name.strip()).otherwise(F.col("name"))), [thread]))


def move_scenes(book: Book, scenes: list[str], thread: str, position: int | None = None, as_outline: bool = False) -> Book:
    """Scenes, from wherever they are, into a line at a place (counted without them; else its end), in
    the given order.  Their times go, for they were another line's."""
    _known(book, [thread])
    spark = book.members.sparkSession
    moving = F.col("scene").isin(*scenes)
    at = float("inf") if position is None else position - 0.5
    own = (F.col("thread") == thread) & (F.col("outline") == as_outline)
    rest = _numbered(book.members.where(~moving), "pos").select("thread", "scene", "outline", "t", "conf", F.col("pos").cast("double").alias("k"), F.lit(0).alias("j"))
    kept = book.members.where(own & moving).select("scene", F.col("t").alias("t0"), F.col("conf").alias("c0"))
    new = spark.createDataFrame([(s, i) for i, s in enumerate(scenes)], "scene string, j int").join(kept, "scene", "left")
    new = new.select(F.lit(thread).alias("thread"), "scene", F.lit(as_outline).alias("outline"), F.col("t0").alias("t"), F.col("c0").alias("conf"), F.lit(at).alias("k"), "j")
    members = _numbered(rest.unionByName(new), "k", "j").select("thread", "pos", "scene", "outline", "t", "conf")
    out = replace(book, threads=_touched(book.threads, [thread]), members=members, pending=book.pending.where(~moving), unassigned=book.unassigned.where(~moving), world_outlines=book.world_outlines.where(~moving))
    return tidy(out)


def reject_pending(book: Book, scenes: list[str]) -> Book:
    """Proposed additions that the author doesn't want become unassigned."""
    moving = F.col("scene").isin(*scenes)
    gone = book.pending.where(moving).select("scene", F.lit("rejected").alias("reason"))
    return replace(book, pending=book.pending.where(~moving), unassigned=book.unassigned.select("scene", "reason").union(gone))


def merge_threads(book: Book, ids: list[str]) -> Book:
    """Lines of one world as the first of them: scenes one after another, times only where both lines
    are aligned (shifted to the first one's), the main line staying main."""
    if len(set(ids)) < 2:
        raise ValueError("a merge takes two lines or more")
    _known(book, ids)
    chosen = book.threads.where(F.col("id").isin(*ids))
    if chosen.select("world").distinct().count() != 1:
        raise ValueError("lines of different worlds can't be merged")
    into = book.main if book.main in ids else ids[0]
    order = F.array_position(F.array(*map(F.lit, [into, *(i for i in ids if i != into)])), F.col("thread"))
    offs = chosen.select(F.col("id").alias("thread"), F.col("offset").alias("o"))
    base = chosen.where(F.col("id") == into).select(F.col("offset").alias("base"))
    mine = book.members.where(F.col("thread").isin(*ids)).join(offs, "thread").crossJoin(F.broadcast(base))  # one row
    t = F.when(F.col("thread") == into, F.col("t")).otherwise(F.col("t") + F.col("o") - F.col("base"))
    joined = mine.withColumns({"_o": order, "t": t, "conf": F.when(t.isNotNull(), F.col("conf")), "thread": F.lit(into)})
    joined = _numbered(joined, "_o", "pos").select("thread", "pos", "scene", "outline", "t", "conf")
    renamed = lambda df: df.withColumn("thread", F.when(F.col("thread").isin(*ids), into).otherwise(F.col("thread")))
    others = [i for i in ids if i != into]
    out = replace(book, threads=_touched(book.threads.where(~F.col("id").isin(*others)), [into]), members=book.members.where(~F.col("thread").isin(*ids)).select("thread", "pos", "scene", "outline", "t", "conf").unionByName(joined), crossings=renamed(book.crossings), gaps=renamed(book.gaps), pending=renamed(book.pending))
    return tidy(out)


def split_thread(book: Book, thread: str, scene: str, new_id: str) -> Book:
    """A line from a scene on becomes a new line of the same world and offset."""
    _known(book, [thread])
    at = book.members.where((F.col("thread") == thread) & (F.col("scene") == scene) & ~F.col("outline")).select("pos").first()
    if at is None or at.pos == 0:
        raise ValueError("a line is split at a scene of its own that isn't the first")
    later = (F.col("thread") == thread) & ~F.col("outline") & (F.col("pos") >= at.pos)
    members = _numbered(book.members.withColumn("thread", F.when(later, new_id).otherwise(F.col("thread"))), "pos")
    new = book.threads.where(F.col("id") == thread).withColumns({"id": F.lit(new_id), "name": F.concat("name", F.lit("（下）"))})
    moved = book.members.where(later).select("scene")
    follow = lambda df, c: df.join(moved.select(F.col("scene").alias(c), F.lit(True).alias("_m")), c, "left").withColumn("thread", F.when((F.col("thread") == thread) & F.col("_m"), new_id).otherwise(F.col("thread"))).drop("_m")
    crossings = follow(book.crossings, "scene").select("thread", "scene", "main_scene")
    gaps = follow(book.gaps, "after").select("gap", "thread", "after", "before")
    return tidy(replace(book, threads=_touched(book.threads.unionByName(new), [thread, new_id]), members=members, crossings=crossings, gaps=gaps))


def move_thread(book: Book, thread: str, world: str) -> Book:
    _known(book, [thread])
    return replace(book, threads=_touched(book.threads.withColumn("world", F.when(F.col("id") == thread, world).otherwise(F.col("world"))), [thread]))


def set_main(book: Book, thread: str) -> Book:
    """Another main line: offsets are counted from its own, if it has one."""
    _known(book, [thread])
    base = book.threads.where(F.col("id") == thread).select(F.col("offset").alias("base"))
    both = book.threads.crossJoin(F.broadcast(base))  # one row
    offset = F.when(F.col("id") == thread, 0.0).when(F.col("base").isNull(), F.col("offset")).otherwise(F.col("offset") - F.col("base"))
    return tidy(replace(book, threads=_touched(both.withColumn("offset", offset).drop("base"), [thread]), main=thread))


def move_chapter(chapters: DataFrame, volume: int, no: int, to_volume: int, to_no: int) -> DataFrame:
    """Chapters (volume, no, title) with one moved to a place counted before it is taken out; volumes
    left empty go."""
    moving = (F.col("volume") == volume) & (F.col("no") == no)
    rows = chapters.withColumns({"volume": F.when(moving, to_volume).otherwise(F.col("volume")), "_k": F.when(moving, F.lit(to_no) - 0.5).otherwise(F.col("no").cast("double"))})
    rows = rows.withColumn("no", (F.row_number().over(W.partitionBy("volume").orderBy("_k")) - 1).cast("long")).drop("_k")
    dense = rows.select("volume").distinct().withColumn("_v", (F.row_number().over(W.orderBy("volume")) - 1).cast("long"))
    return rows.join(dense, "volume").drop("volume").withColumnRenamed("_v", "volume")


def place_unplaced(items: DataFrame, unplaced: DataFrame, scene: str, chapter: int, index: int) -> tuple[DataFrame, DataFrame]:
    """Items (chapter, no, item) with an unplaced scene (item) put in, and what is left unplaced."""
    new = unplaced.where(F.col("item") == scene).select(F.lit(chapter).alias("chapter"), (F.lit(index) - 0.5).alias("_k"), "item")
    rows = items.select("chapter", F.col("no").cast("double").alias("_k"), "item").unionByName(new)
    rows = rows.withColumn("no", (F.row_number().over(W.partitionBy("chapter").orderBy("_k")) - 1).cast("long")).drop("_k")
    return rows, unplaced.where(F.col("item") != scene)
