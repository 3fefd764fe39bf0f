"""Answers given for overlapping windows of a book, joined into one list of chapters and volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..params import DEFAULTS


def owned(windows: DataFrame, overlap: int = DEFAULTS.window_overlap) -> DataFrame:
    """(book, window, first, low, high): each window with the rows that it alone decides on, [low, high).
    Neighbours part in the middle of their overlap, so an answer is never taken from a window's edge.
    windows: book, window (from 0), first, last (the row behind its end)."""
    order = W.partitionBy("book").orderBy("window")
    low = F.when(F.col("window") == F.min("window").over(W.partitionBy("book")), F.lit(0)).otherwise(F.col("first") + overlap // 2)
    rows = windows.withColumn("low", low.cast("long"))
    return rows.select("book", "window", "first", "low", F.coalesce(F.lead("low").over(order), F.col("last")).cast("long").alias("high"))


def stitched(windows: DataFrame, answers: DataFrame, overlap: int = DEFAULTS.window_overlap) -> DataFrame:
    """(book, kind, title, start): the book's chapters and volumes from its windows' answers.

    answers: book, window, kind ('chapter' or 'volume'), title, start (a row of the window, from 0).  An
    answer counts where its window decides.  A volume moves to the first chapter at or behind it; without one it goes, and of
    volumes that meet at a chapter the one that began first stays.  Of several of a kind at one row the least title stays;
    answers of unknown windows, and null starts, go.
    """
    own = owned(windows, overlap)
    rows = answers.join(own, ["book", "window"]).withColumn("row", (F.col("first") + F.col("start")).cast("long"))
    rows = rows.where((F.col("row") >= F.col("low")) & (F.col("row") < F.col("high")))
    rows = rows.groupBy("book", "kind", "row").agg(F.min("title").alias("title"))
    # seen from the book's end: the last chapter met is the next one
    back = W.partitionBy("book").orderBy(F.col("row").desc(), F.col("kind")).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.last(F.when(F.col("kind") == "chapter", F.col("row")), True).over(back))
    volumes = rows.where("kind = 'volume' and at is not null").groupBy("book", "kind", "at").agg(F.min_by("title", "row").alias("title"))
    chapters = rows.where("kind = 'chapter'").select("book", "kind", "title", F.col("row").alias("start"))
    return chapters.unionByName(volumes.select("book", "kind", "title", F.col("at").alias("start")))
