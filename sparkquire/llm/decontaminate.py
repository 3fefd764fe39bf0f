"""Benchmark passages in documents by winnowing, in DataFrame functions only.

A fingerprint is the hash of k words.  Of the fingerprints in every window of ``window`` words the
least is kept (of equal ones the rightmost), once for a run of windows that share it: about
2 / (w + 1) of all places, w fingerprints standing in a window.  The choice depends on the
window's words alone, so two texts that share a window share a kept fingerprint.
Documents' fingerprints are joined with the benchmark's, and each hit is extended to the left and
the right: every window over its words that lies in the document is compared, by a hash
of all its words, with the benchmark's windows.

Items shorter than a window are windows of their own length.  They are winnowed likewise, with the
shortest of them as the window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words stand ASCII characters other than letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of fingerprints or windows (24 bytes each) up to which the benchmark's side is broadcast; beyond, both sides shuffle.
BROADCAST_WINDOWS = 1_000_000

#: (words of a fingerprint, words of a window)
Kind = tuple[int, int]


def word_hashes(text: Column) -> Column:
    """A hash of each word, A-Z lower-cased; translate runs only on words that lower() changes."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), F.lit(""))
    return F.transform(words, lambda w: F.xxhash64(F.when(F.lower(w) == w, w).otherwise(F.translate(w, UPPER, LOWER))))


def _kept(w: int, g: str) -> Column:
    """Whether some window of w fingerprints keeps the one at place p of the array g; beyond its ends stand nulls."""
    own, p = F.get(g, F.col("p")), F.col("p")

    def reach(side: int) -> Column:
        """How many neighbours on that side, one after another, are no less (on the right: greater)."""
        out = F.lit(w - 1)
        for d in range(w - 1, 0, -1):
            near = F.get(g, p + side * d)
            out = F.when(near > own if side > 0 else near >= own, out).otherwise(d - 1)
        return out

    return (p >= 0) & own.isNotNull() & (reach(-1) + reach(1) + 1 >= w)


def _grams(k: int) -> Column:
    """The hashes of every k words of h, one after another."""
    made = F.transform(F.sequence(F.lit(0), F.size("h") - k), lambda i: F.xxhash64(F.lit(k), *(F.get("h", i + j) for j in range(k))))
    return F.when(F.size("h") >= k, made).otherwise(F.array().cast("array<bigint>"))


def _reach(kinds: Sequence[Kind], lengths: Sequence[Sequence[int]]) -> int:
    """How far before a fingerprint the windows over its words begin at most."""
    return max(n - k for (k, _), of_kind in zip(kinds, lengths) for n in of_kind)


def fingerprints(rows: DataFrame, kinds: Sequence[Kind], lengths: Sequence[Sequence[int]] | None = None, every_row: bool = False) -> DataFrame:
    """rows with h (word hashes) to a row for each kept fingerprint: p, kind (its number), fp, n_words
    and near, the words of all windows over it whose lengths (by kind) are given.
    every_row adds a row of p = -1 for each input row.  h is dropped."""
    lengths = lengths or [[n] for _, n in kinds]
    back, ahead = _reach(kinds, lengths), max(max(x) for x in lengths)
    rows = rows.select("*", F.size("h").alias("n_words"), *(_grams(k).alias(f"g{i}") for i, (k, _) in enumerate(kinds)))
    first = -1 if every_row else 0
    rows = rows.withColumn("p", F.explode(F.sequence(F.lit(first), F.greatest(F.col("n_words") - 1, F.lit(first)))))
    kept = [_kept(n - k + 1, f"g{i}") for i, (k, n) in enumerate(kinds)]
    rows = rows.where(reduce(lambda a, b: a | b, kept, F.col("p") == -1))
    fp = [F.get(f"g{i}", F.col("p")) for i in range(len(kinds))]
    if len(kinds) > 1:
        fp = [F.when(x, g) for x, g in zip(kept, fp)]
    rows = rows.select("*", *(x.alias(f"f{i}") for i, x in enumerate(fp))).drop(*(f"g{i}" for i in range(len(kinds))))
    near = F.when(F.col("p") >= 0, F.slice("h", F.greatest(F.col("p") - back, F.lit(0)) + 1, F.lit(back + ahead)))
    rows = rows.withColumn("near", near).drop("h")
    if len(kinds) == 1:
        return rows.withColumn("kind", F.lit(0)).withColumnRenamed("f0", "fp")
    each = F.array(*(F.when(F.col(f"f{i}").isNotNull(), F.struct(F.lit(i).alias("kind"), F.col(f"f{i}").alias("fp"))) for i in range(len(kinds))))
    none = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(None).cast("long").alias("fp")))
    rows = rows.withColumn("x", F.explode(F.when(F.col("p") == -1, none).otherwise(F.array_compact(each))))
    return rows.select("*", "x.kind", "x.fp").drop("x", *(f"f{i}" for i in range(len(kinds))))


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, n, full): the windows of items of at least ``window`` words, and the whole of
    shorter ones; items without words have none.  items: item_id, h."""
    size = F.least(F.size("h"), F.lit(window))
    rows = items.where(F.size("h") > 0).select("item_id", size.alias("n"), "h", F.explode(F.sequence(F.lit(0), F.size("h") - size)).alias("j"))
    return rows.select("item_id", "n", F.xxhash64("n", F.slice("h", F.col("j") + 1, F.col("n"))).alias("full"))


def _over(n: int, k: int, back: int) -> Column:
    """The windows of n words over the k words at p: structs of j (where it begins), n, full."""
    first, last = F.greatest(F.col("p") - (n - k), F.lit(0)), F.least(F.col("p"), F.col("n_words") - n)
    base = F.greatest(F.col("p") - back, F.lit(0))
    made = F.transform(F.sequence(first, last), lambda j: F.struct(j.alias("j"), F.lit(n).alias("n"), F.xxhash64(F.lit(n), F.slice("near", j - base + 1, F.lit(n))).alias("full")))
    return F.when(first <= last, made).otherwise(F.array().cast("array<struct<j:int,n:int,full:bigint>>"))


def extended(hits: DataFrame, kinds: Sequence[Kind], lengths: Sequence[Sequence[int]]) -> DataFrame:
    """Joined fingerprints to a row for each window (j, n, full) over their words; lengths: the windows'
    lengths of each kind.  A row of p = -1 stays one, with j = -1."""
    back = _reach(kinds, lengths)
    windows = F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).alias("n"), F.col("rid").alias("full")))
    windows = F.when(F.col("p") == -1, windows)
    for i, (k, _) in enumerate(kinds):
        windows = windows.when(F.col("kind") == i, F.concat(*(_over(n, k, back) for n in lengths[i])))
    return hits.withColumn("x", F.explode(windows)).select("doc_id", "rid", "n_words", "x.j", "x.n", "x.full")


def judged(docs: DataFrame, bench: DataFrame, window: int = 10, k: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, rid, copies, n_words, n_hit, ids): a row for each different (id, text) of ``docs``; rid is
    xxhash64(doc_id, text), ids the sorted item ids as texts (see ``contaminated``)."""
    if not 0 < k <= window:
        raise ValueError("a fingerprint has at most the words of a window")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("rid"), word_hashes(F.col(text)).alias("h"))
    items = bench.select(F.col(item_id).cast("string").alias("item_id"), word_hashes(F.col(item_text)).alias("h"))
    known = cut(benchmark_windows(items, window).distinct())
    short = sorted(r.n for r in known.where(F.col("n") < window).select("n").distinct().collect())  # fewer than ``window``
    kinds, lengths = [(k, window)], [[window]]
    prints = [fingerprints(items.where(F.size("h") >= window), kinds[:1]).select("kind", "fp")]
    if short:
        kinds.append(((short[0] + 1) // 2, short[0]))
        lengths.append(short)
        prints.append(fingerprints(items.where(F.size("h") < window), kinds[1:]).select(F.lit(1).alias("kind"), "fp"))
    prints = cut(prints[0].union(prints[-1]).distinct())
    windows = cut(known.select("n", "full").distinct())
    # what is broadcast is counted first; beyond the bound both sides are shuffled
    side = lambda df: F.broadcast(df) if df.count() <= BROADCAST_WINDOWS else df

    # rows of p = -1 carry the document itself: theirs are keys that spread and match nothing
    placed = fingerprints(rows, kinds, lengths, every_row=True).withColumn("fp", F.coalesce("fp", "rid")).withColumn("kind", F.when(F.col("p") >= 0, F.col("kind")).otherwise(-1))
    hits = placed.join(side(prints.withColumn("met", F.lit(True))), ["kind", "fp"], "left").where("p = -1 or met")
    found = extended(hits, kinds, lengths).join(side(windows.withColumn("hit", F.lit(True))), ["n", "full"], "left").where("j = -1 or hit")
    is_hit = F.col("j") >= 0
    # cut, for two branches read it and documents are to be read once
    marked = cut(found.groupBy("doc_id", "rid").agg(
        F.max("n_words").alias("n_words"),
        F.sum((~is_hit).cast("long")).alias("copies"),
        F.collect_set(F.when(is_hit, F.struct("j", "n"))).alias("hits"),
        F.collect_set(F.when(is_hit, F.struct("n", "full"))).alias("windows"),
    ))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["j"], x["j"] + x["n"] - 1)))))
    none = F.array().cast("array<string>")
    clean = marked.where(F.size("hits") == 0).select("doc_id", "rid", "copies", "n_words", F.lit(0).alias("n_hit"), none.alias("ids"))
    dirty = marked.where(F.size("hits") > 0).select("doc_id", "rid", "copies", "n_words", covered.alias("n_hit"), F.explode("windows").alias("x"))
    dirty = dirty.select("doc_id", "rid", "copies", "n_words", "n_hit", "x.n", "x.full").join(side(known.where("item_id is not null")), ["n", "full"], "left")
    dirty = dirty.groupBy("doc_id", "rid", "copies", "n_words", "n_hit").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    return clean.union(dirty)


def contaminated(docs: DataFrame, bench: DataFrame, window: int = 10, k: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A word is hit if it lies in any occurrence of a benchmark window.  n_items: different
    items with occurring windows; items_sha256: of their ids as texts, sorted, comma-joined (of
    the empty text if none).  A null text has no words; a null item_id counts as no item
    although its words hit; repeated rows each give a row; an empty benchmark hits nothing.
    """
    rows = judged(docs, bench, window, k, doc_id, text, item_id, item_text).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def contaminated_keys(docs: DataFrame, bench: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """(key, doc_id) of the contaminated rows, key being xxhash64(doc_id, text)."""
    return judged(docs, bench, window, k).where("n_hit > 0").select(F.col("rid").alias("key"), "doc_id")
