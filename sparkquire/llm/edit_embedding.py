"""Fingerprints of whole texts by a randomised edit embedding, and near copies by banding them.

A text is walked over step by step: at step t the character under the pointer is put out, and one shared
random bit for (t, character) decides whether the pointer goes on.  Two texts walked with the same bits fall into
step again soon after an edit, so a small edit distance becomes a small Hamming distance of what they put out.
A fingerprint samples SLOTS steps of that output, each uniform over the walk's length and nearly independent of it: a
slot's steps are the records of a random priority, and the last record before the walk's end is taken.
A sample is a hash of the character in four bits, so a fingerprint is a string of hex digits.

Bands of digits name the buckets in which near copies meet; what meets is verified digit by digit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.numbering import numbered
from ..storage import cut
from .bytetext import give_back

SLOTS = 128
#: Steps after which the shared bits repeat, and classes of characters that share bits.
PERIOD, CLASSES = 4096, 256
#: Digits of a band: at a likeness of 0.8 a pair shares one of the 16 bands in 19 of 20 cases, at 0.9 nearly always.
BAND_DIGITS = 8
#: Characters that are walked over at once.
STRETCH = 1 << 16
#: Fingerprints of a bucket that are compared at once; a larger bucket is cut into such blocks.
BLOCK = 512
#: Steps up to which records are known: walks of texts of 2**38 characters.
FURTHEST = 1 << 40


@cache
def _pace() -> tuple[bytes, ...]:
    """For each class and step modulo PERIOD: the steps until the pointer leaves the character."""
    bits = np.random.Generator(np.random.PCG64(11)).integers(0, 2, (CLASSES, 2 * PERIOD), dtype=np.uint8)
    bits[:, PERIOD - 1] = 1
    bits[:, PERIOD:] = bits[:, :PERIOD]
    out = np.ones((CLASSES, 2 * PERIOD), np.int64)
    for t in range(2 * PERIOD - 2, -1, -1):
        out[:, t] = np.where(bits[:, t] > 0, 1, out[:, t + 1] + 1)
    return tuple(row.astype(np.uint8).tobytes() for row in out[:, :PERIOD])


@cache
def _records() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps (ascending), their slots, and each slot's steps as a row of a table filled up with FURTHEST."""
    rng, rows = np.random.Generator(np.random.PCG64(13)), []
    for _ in range(SLOTS):
        at, least, found = 0, rng.random(), []
        while at < FURTHEST:
            found.append(at)
            at += int(min(rng.geometric(max(least, 1e-15)), FURTHEST))
            least *= rng.random()
        rows.append(found)
    table = np.full((SLOTS, max(map(len, rows))), FURTHEST, np.int64)
    for s, found in enumerate(rows):
        table[s, : len(found)] = found
    slot, _ = np.nonzero(table < FURTHEST)
    steps = table[table < FURTHEST]
    order = np.argsort(steps, kind="stable")
    return steps[order], slot[order], table


def _digits(points: np.ndarray, slots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (slots.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(15)).astype(np.uint8)


class Walk:
    """A walk over text that may go on: the step it has come to and the sample last taken for each slot."""

    def __init__(self) -> None:
        self.step, self.digits = 0, np.zeros(SLOTS, np.uint8)

    def copy(self) -> Walk:
        other = Walk()
        other.step, other.digits = self.step, self.digits.copy()
        return other

    def over(self, text: str) -> Walk:
        steps, slots, _ = _records()
        pace, most = _pace(), PERIOD - 1
        for a in range(0, len(text), STRETCH):
            points = np.frombuffer(text[a : a + STRETCH].encode("utf-32-le", "surrogatepass"), np.uint32)
            t, entered = self.step, []
            enter = entered.append
            for c in ((points ^ (points >> 8)) & (CLASSES - 1)).astype(np.uint8).tobytes():
                enter(t)
                t += pace[c][t & most]
            first, last = np.searchsorted(steps, [self.step, t])
            if first < last:
                at = np.searchsorted(np.array(entered), steps[first:last], side="right") - 1
                # of a slot's steps in this stretch the last one stands: assignment keeps the later of equal places
                self.digits[slots[first:last]] = _digits(points[at], slots[first:last])
            self.step = t
        return self

    def fingerprint(self) -> bytes:
        """SLOTS digits of four bits; of an empty text none."""
        return (self.digits[::2] << 4 | self.digits[1::2]).tobytes() if self.step else b""


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal digits, less what chance makes equal; rows of packed digits."""
    other = a ^ b
    same = ((other & 15) == 0).mean(axis=-1) + ((other >> 4) == 0).mean(axis=-1)
    return np.maximum(0.0, (8 * same - 1) / 15)


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of bytes for each fingerprint, and which of them are empty or null."""
    some = [x or b"" for x in column.to_pylist()]
    empty = np.array([not x for x in some], bool)
    return np.frombuffer(b"".join(x or bytes(SLOTS // 2) for x in some), np.uint8).reshape(-1, SLOTS // 2), empty


def _alike(x: pa.Array, y: pa.Array) -> np.ndarray:
    (x, none_x), (y, none_y) = _packed(x), _packed(y)
    return np.where(none_x | none_y, (none_x & none_y).astype(float), _likeness(x, y))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints (binary), 0 to 1: equal ones 1 (empty ones too), an empty and another one 0; a null counts as empty."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array(_alike(x, y))

    return F.arrow_udf(run, "double")(a, b)


def _pressed(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts as zstd frames: less than two thirds of what Spark's own compression makes of them in a shuffle."""
    press = zstandard.ZstdCompressor(level=1).compress
    for texts in column:
        yield pa.array([press(x.as_py().encode()) for x in texts], pa.binary())


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first ``k`` code points of each packed text, packed."""
    press, open_ = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
    for batch in batches:
        heads = [press(open_(x.as_py()).decode()[: k.as_py()].encode()) for x, k in zip(batch["body"], batch["k"])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(heads, pa.binary())], [*batch.schema.names[:4], "head"])
    give_back()


def _walked(share: int):
    """(four key columns, body, head) to fingerprints of the text and of the text whose last 1/share is replaced by the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            size, prints, edited, digests = [], [], [], []
            for text, head in zip(batch["body"], batch["head"]):
                text, head = open_(text.as_py()).decode(), open_(head.as_py()).decode()
                keep = len(text) - len(text) // share
                kept = Walk().over(text[:keep])
                edited.append(kept.copy().over(head).fingerprint())
                digests.append(hashlib.sha256((text[:keep] + head).encode()).digest())
                prints.append(kept.over(text[keep:]).fingerprint())
                size.append(len(text))
            prints, edited = pa.array(prints, pa.binary()), pa.array(edited, pa.binary())
            made = [pa.array(size, pa.int64()), pa.array(digests, pa.binary()), prints, edited, pa.array(_alike(prints, edited))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made], [*batch.schema.names[:4], "n_chars", "digest", "fingerprint", "edited", "near_edited"])
        give_back()

    return run


def _hex(column: str) -> Column:
    return F.lower(F.hex(column))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row: SLOTS hex digits, of an empty or null text none.  Equal
    texts have equal fingerprints, whatever the ids; other columns are not read."""

    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in column:
            yield pa.array([Walk().over(x.as_py() or "").fingerprint() for x in texts], pa.binary())
        give_back()

    out = docs.select(F.col(doc_id).alias("doc_id"), F.arrow_udf(run, "binary")(F.col(text)).alias("fingerprint"))
    return out.withColumn("fingerprint", _hex("fingerprint"))


def edited_fingerprints(docs: DataFrame, share: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text: of n code points the last floor(n / share) give way to the first as many (or all) of the
    next document's text, by descending id; after the last document comes the first.  A document here is
    a pair of id and text: rows that repeat one have the same next one, and texts of one id follow each other by their SHA-256;
    a null id comes last.  A lone document is its own next.  Null texts count as empty; an empty text has an empty fingerprint,
    which is like another empty one (1) and unlike all others (0).

    Texts are shuffled once, compressed, by id and hash; that exchange serves both a document's own row and the beginning that
    the document before it takes.  Numbers, hashes and fingerprints are all else that moves.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    light = rows.groupBy("doc_id", "h").agg(F.max(F.char_length("text")).alias("n"), F.count("*").alias("copies"))
    known = numbered(light, [F.col("doc_id").desc_nulls_last(), F.col("h")], "no")
    total, repeated = known.agg(F.count("*"), F.coalesce(F.max("copies"), F.lit(0)) > 1).first()
    after = known.select(F.col("doc_id").alias("next_id"), F.col("h").alias("next_h"), F.when(F.col("no") == 1, F.lit(total)).otherwise(F.col("no") - 1).alias("no"))
    links = known.join(after, "no").select("doc_id", "h", F.floor(F.col("n") / share).alias("k"), "next_id", "next_h")
    kind = rows.schema["doc_id"].dataType.simpleString()
    keys = f"doc_id {kind}, h binary, next_id {kind}, next_h binary"
    # both joins below read one exchange of these rows; rows of one key are copies, and a join may split them
    rows = rows.select("doc_id", "h", F.arrow_udf(_pressed, "binary")(F.col("text")).alias("body"))
    a, b = links.alias("a"), rows.alias("b")
    heads = a.join(b, F.col("a.next_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.next_h") == F.col("b.h")))
    heads = heads.select("a.doc_id", "a.h", "next_id", "next_h", "body", "k").mapInArrow(_heads, f"{keys}, head binary")
    if repeated:
        heads = heads.distinct()
    own = rows.alias("a").join(heads.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")))
    own = own.select("a.doc_id", "a.h", "next_id", "next_h", "body", "head")
    made = cut(own.mapInArrow(_walked(share), f"{keys}, n_chars long, digest binary, fingerprint binary, edited binary, near_edited double"))
    prints = made.select(F.col("doc_id").alias("other"), F.col("h").alias("other_h"), F.col("fingerprint").alias("after"))
    if repeated:
        prints = prints.dropDuplicates(["other", "other_h"])
    out = made.join(prints, F.col("next_id").eqNullSafe(F.col("other")) & (F.col("next_h") == F.col("other_h")))
    return out.select(
        "doc_id", "n_chars", _hex("digest").alias("edited_sha256"), _hex("fingerprint").alias("fingerprint"), _hex("edited").alias("edited_fingerprint"),
        "near_edited", likeness(F.col("fingerprint"), F.col("after")).alias("near_next"),
    )


def _forest(least: float):
    """A pair of blocks of one bucket: links of a spanning forest over the pairs that are alike enough."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        names, side = pa.array([bytes.fromhex(x) for x in table["fingerprint"].to_pylist()], pa.binary()), np.asarray(table["own"].combine_chunks())
        digits, _ = _packed(names)
        left = np.flatnonzero(side == i)
        right = left if i == j else np.flatnonzero(side == j)
        root, a, b = np.arange(len(side)), [], []
        for x in left:
            near = right[_likeness(digits[right], digits[x]) >= least]
            for y in near[root[near] != root[x]]:
                if root[y] != root[x]:
                    a.append(x)
                    b.append(y)
                    root[root == root[y]] = root[x]
        whole = table["fingerprint"].combine_chunks()
        return pa.table({"a": whole.take(pa.array(a, pa.int64())), "b": whole.take(pa.array(b, pa.int64()))})

    return run


def near_copies(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for every row of (doc_id, fingerprint): the smallest id reachable over pairs of
    fingerprints that share a band and have a likeness of ``least`` or more.

    Equal fingerprints are one class, of which one member is banded.  A bucket of more than about BLOCK
    different fingerprints is cut into blocks by a hash, and each pair of blocks is a task that gives a forest, never pairs.
    Empty or null fingerprints are linked with nothing, null ids are nobody's component but their own.
    """
    prints = cut(prints.select("doc_id", "fingerprint"))
    classes = prints.where("fingerprint <> ''").select("fingerprint").distinct()
    bands = F.explode(F.transform(F.sequence(F.lit(0), F.lit(SLOTS // BAND_DIGITS - 1)), lambda k: F.concat_ws(":", k.cast("string"), F.substring("fingerprint", k * BAND_DIGITS + 1, F.lit(BAND_DIGITS)))))
    rows = cut(classes.select(bands.alias("bucket"), "fingerprint"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("bucket", "fingerprint", "own", other.alias("other"))
    pairs = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fingerprint")
    links = pairs.groupBy("bucket", "i", "j").applyInArrow(_forest(least), "a string, b string")
    found = components(links).select(F.col("node").alias("fingerprint"), F.col("component").alias("class"))
    named = prints.where("fingerprint <> ''").join(found, "fingerprint", "left").withColumn("class", F.coalesce("class", "fingerprint"))
    roots = named.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(cut(roots), "class").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = prints.where("fingerprint is null or fingerprint = ''").select("doc_id", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
