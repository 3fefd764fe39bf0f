"""Finding stated texts verbatim in many documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, modest_batches
from .sieve import Sieve

KEY_CHARS = 8
#: Characters whose stretches are hashed at once.
SLICE_CHARS = 500_000
#: An odd factor for each character of a stretch.
_ODD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def naming(rows: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """rows joined with the names that stand in their short text: stretches of the text of the names'
    lengths meet equal names, so neither side is compared with all of the other.  The driver
    gets the distinct lengths.  A name counts once for a row's text; blank names never do."""
    sizes = sorted(r[0] for r in names.where(F.length(name) > 0).select(F.length(name)).distinct().collect())
    none = F.array().cast("array<string>")

    def stretches(n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(F.col(text), i, F.lit(n)))).otherwise(none)

    parts = [stretches(n) for n in sizes]
    every = F.array_distinct(F.concat(*parts)) if parts else none
    return rows.withColumn("_part", F.explode(every)).join(names, F.col("_part") == F.col(name)).drop("_part")


#: Items whose hashes are broadcast (rows of two numbers); beyond, stretches are shuffled to meet them.
BROADCAST_ITEMS = 200_000


def verbatim(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, item): documents (id, text) that contain an item (item, text) whole; empty items are in none.

    The rarest would be the best key; any stretch of the item is right: here the KEY_CHARS
    characters in its middle, whose hash is looked up among those of all stretches of that length of the documents.  What meets
    are ids and hashes; texts are fetched for the pairs that do, and compared.  Shorter items meet the documents' stretches of
    their own length (``naming``).
    """
    modest_batches(docs.sparkSession)
    keyed = items.where(F.length("text") >= KEY_CHARS)
    middle = F.floor((F.length("text") - KEY_CHARS) / 2).cast("int")
    keyed = cut(keyed.select("item", _stretches()(F.substr("text", middle + 1, F.lit(KEY_CHARS))).alias("h")).select("item", F.col("h")[0].alias("h")))
    sieve = Sieve(keyed.select(F.col("h").alias("key")))
    keyed = F.broadcast(keyed) if keyed.count() <= BROADCAST_ITEMS else keyed
    hits = docs.select("id", F.explode(_stretches(sieve)(F.coalesce("text", F.lit("")))).alias("h")).join(keyed, "h").select("id", "item").distinct()
    found = hits.join(docs.select("id", "text"), "id").join(items.select("item", F.col("text").alias("wanted")), "item").where(F.contains("text", "wanted"))
    brief = items.where((F.length("text") < KEY_CHARS) & (F.length("text") > 0)).select("item", F.col("text").alias("wanted"))
    return found.select("id", "item").union(naming(docs.select("id", "text"), "text", brief, "wanted").select("id", "item")).distinct()


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all stretches of KEY_CHARS characters of the texts one after another, the number of the text of each)."""
    sizes = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = max(len(points) - KEY_CHARS + 1, 0)
    h = np.zeros(n, np.uint64)
    for j, odd in enumerate(_ODD):
        h += points[j : j + n] * np.uint64(odd)
    of = np.repeat(np.arange(len(sizes)), sizes)
    whole = of[:n] == of[len(of) - n :]  # not from one text into the next
    h = h[whole]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64), of[:n][whole]


def _stretches(sieve: Sieve | None = None) -> Callable[[Column], Column]:
    """The different hashes of a text's stretches that the sieve lets pass, as a list."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts, ends, first = [], np.cumsum(np.asarray(pc.utf8_length(texts)).astype(np.int64)), 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE_CHARS, side="right")))
                h, of = _hashed(texts.slice(first, last - first))
                if sieve is not None:
                    keep = sieve.passes(h)
                    h, of = h[keep], of[keep]
                pair = np.unique(np.stack([of, h], axis=1), axis=0) if len(h) else np.zeros((0, 2), np.int64)
                counts = np.bincount(pair[:, 0], minlength=last - first)
                parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(pair[:, 1])))
                first = last
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<bigint>")
