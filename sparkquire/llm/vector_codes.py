"""Product codes of vectors by exact integer Lloyd rounds under Hamerly's bounds.

A vector's components become integers, floor(scale * x), and it is cut into equal consecutive
parts, each with a codebook.  Between rounds every part keeps an upper bound of its distance
to its entry and one lower bound of its distance to any other.  Bounds move by what entries
have moved, rounded outwards.  Only where they fail to tell strictly that the entry is still
the nearest is the distance taken again, and only where that fails too are all entries
scanned in integers, so ties always go to the lower index and codes are those of plain Lloyd rounds.

Vectors are packed into blocks of rows.  A round is one pass over the blocks, checkpointed with its
bounds and with the sums that changed; the driver gets one sum for each component of each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, spread
from .bytetext import give_back

BLOCK_ROWS = 4096
#: Labels whose sums are broadcast; beyond, rows and sums are joined by label.
BROADCAST_LABELS = 100_000
_BLOCK = ["ids", "labels", "size", "x", "code", "upper", "lower"]
#: In place of an entry's index before the first assignment.
UNASSIGNED = 255


def _up(x: np.ndarray) -> np.ndarray:
    """The float32 above x: a bound that has lost nothing by rounding."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _squares(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distances of rows to an entry, or row by row to as many entries, in integers."""
    d = x - entry
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Books:
    """Entries of all parts (parts x entries x width) and how far each has moved since the last assignment."""

    entries: np.ndarray
    moved: np.ndarray

    def __post_init__(self) -> None:
        parts, k, _ = self.entries.shape
        #: The furthest that an entry other than a row's own has moved, and half an entry's distance to the nearest other.
        self.others, self.half = np.zeros((parts, k), np.float32), np.full((parts, k), np.inf, np.float32)
        for p in range(parts):
            for j in range(k):
                rest = np.arange(k) != j
                if rest.any():
                    self.others[p, j] = self.moved[p][rest].max()
                    self.half[p, j] = _down(np.sqrt(_squares(self.entries[p][rest], self.entries[p, j]).astype(float)) / 2).min()

    def assign(self, p: int, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of part ``p`` for each row, with bounds that hold for it."""
        book, code, upper, lower = self.entries[p], code.copy(), upper.copy(), lower.copy()
        open_ = np.flatnonzero(code == UNASSIGNED)
        if len(open_) == 0:
            own = code
            upper, lower = _up(upper.astype(float) + self.moved[p][own]), _down(lower.astype(float) - self.others[p][own])
            apart = np.maximum(lower, self.half[p][own])
            open_ = np.flatnonzero(~(upper < apart))
            upper[open_] = _up(np.sqrt(_squares(x[open_], book[own[open_]]).astype(float)))
            open_ = open_[~(upper[open_] < apart[open_])]
        if len(open_):
            d = np.stack([_squares(x[open_], entry) for entry in book], axis=1)
            best = d.argmin(axis=1)  # the first of equal ones
            near = np.sqrt(d[np.arange(len(d)), best].astype(float))
            d[np.arange(len(d)), best] = np.iinfo(np.int64).max
            code[open_], upper[open_] = best, _up(near)
            lower[open_] = _down(np.sqrt(d.min(axis=1).astype(float))) if len(book) > 1 else np.inf
        return code, upper, lower


def _packed(scale: int, dim: int, parts: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (vec_id, label, vector) as blocks: ids and labels as lists, integers in the least type that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), block):
                batch = whole.slice(a, block)
                n = len(batch)
                x = np.floor(scale * np.asarray(batch["vector"].flatten()).reshape(n, dim))
                top = np.abs(x).max(initial=0)
                x = x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch[c]) for c in ("vec_id", "label")]
                bare = [x.tobytes(), np.full((n, parts), UNASSIGNED, np.uint8).tobytes(), np.full((n, parts), np.inf, np.float32).tobytes(), np.zeros((n, parts), np.float32).tobytes()]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([x.dtype.itemsize]), *(pa.array([b], pa.binary()) for b in bare)], _BLOCK)

    return run


def _rows(block: pa.RecordBatch, i: int, dim: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[block["size"][i].as_py()]
    x = np.frombuffer(block["x"][i].as_buffer(), kind).reshape(-1, dim).astype(np.int64)
    code = np.frombuffer(block["code"][i].as_buffer(), np.uint8).reshape(-1, parts)
    upper, lower = (np.frombuffer(block[c][i].as_buffer(), np.float32).reshape(-1, parts) for c in ("upper", "lower"))
    return x, code, upper, lower


def _round(books, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Assigns a block's parts; ``changed`` adds up, for each part and entry, the components of rows that came
    less those of rows that left, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book: Books = books.value
        parts, k, width = book.entries.shape
        for batch in batches:
            for i in range(len(batch)):
                x, code, upper, lower = (a.copy() for a in _rows(batch, i, dim, parts))
                changed = np.zeros((parts, k, width + 1), np.int64)
                for p in range(parts):
                    own, old = x[:, p * width : (p + 1) * width], code[:, p].copy()
                    code[:, p], upper[:, p], lower[:, p] = book.assign(p, own, old, upper[:, p], lower[:, p])
                    other = code[:, p] != old
                    for side, sign in ((code[:, p], 1), (old, -1)):
                        for j in np.unique(side[other]):
                            if j != UNASSIGNED:
                                rows = other & (side == j)
                                changed[p, j, :width] += sign * own[rows].sum(axis=0)
                                changed[p, j, width] += sign * int(rows.sum())
                one = batch.slice(i, 1)
                made = [code.tobytes(), upper.tobytes(), lower.tobytes()]
                yield pa.RecordBatch.from_arrays([*(one[c] for c in ("ids", "labels", "size", "x")), *(pa.array([b], pa.binary()) for b in made), pa.array([changed.ravel()], pa.list_(pa.int64()))], [*_BLOCK, "changed"])
        give_back()

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for row in batch["changed"]:
            x = np.asarray(row.values)
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])


def _coded(books, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The last assignment as rows: code in hex and the exact error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book: Books = books.value
        parts, _, width = book.entries.shape
        for batch in batches:
            for i in range(len(batch)):
                x, code, upper, lower = _rows(batch, i, dim, parts)
                code, error = code.copy(), np.zeros(len(x), np.int64)
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    code[:, p], _, _ = book.assign(p, own, code[:, p], upper[:, p], lower[:, p])
                    error += _squares(own, book.entries[p][code[:, p]])
                names = pa.array([r.tobytes().hex() for r in code], pa.string())
                yield pa.RecordBatch.from_arrays([batch["ids"][i].values, batch["labels"][i].values, names, pa.array(error)], ["vec_id", "label", "code", "error"])
        give_back()

    return run


def _moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return _up(np.sqrt(((new - old) ** 2).sum(axis=2).astype(float))) * (old != new).any(axis=2)


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every kept row.

    Codebooks begin as the parts of the ``entries`` smallest kept ids (fewer rows: fewer entries; null
    ids come last, rows of one id by their vectors).  Each round assigns all parts and replaces an entry by its
    parts' componentwise floor(sum / count); an entry without parts stays.  code: two hex digits a part.
    label_error: the errors of all rows of that label, null labels together (null where it passes 64 bits).

    Dropped: null vectors, null or non-finite components, vectors whose length isn't that of the smallest
    id's or isn't a positive multiple of ``parts``, and components so large that a squared distance of whole vectors
    may pass 64 bits.  Repeated rows each give a row; an empty table gives none.  Other columns are not read.
    """
    if not 1 <= entries < UNASSIGNED:
        raise ValueError("codes of two hex digits need 1 to 254 entries")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("vector"))
    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    whole = F.expr("vector is not null and size(vector) > 0") & (F.size("vector") % parts == 0)

    def sound(dim: Column) -> Column:
        most = F.floor(F.sqrt(F.lit(float(1 << 61)) / dim)) / scale - 1
        return F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= most), F.lit(False)))

    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = rows.where(whole & sound(F.size("vector"))).orderBy(*order).limit(1).collect()
    kind = f"vec_id {id_kind}, code string, error long, label_error long, codebooks_sha256 string"
    if not first:
        return vectors.sparkSession.createDataFrame([], kind)
    dim = len(first[0].vector)
    kept = rows.where(whole & (F.size("vector") == dim) & sound(F.lit(dim)))
    seeds = [r.vector for r in kept.orderBy(*order).limit(entries).collect()]
    book = np.floor(scale * np.array(seeds)).astype(np.int64).reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2)
    schema = f"ids array<{id_kind}>, labels array<{label_kind}>, size long, x binary, code binary, upper binary, lower binary"
    state, sums, moved = spread(kept).mapInArrow(_packed(scale, dim, parts, BLOCK_ROWS), schema), 0, np.zeros(book.shape[:2], np.float32)
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        state = cut(state.mapInArrow(_round(context.broadcast(Books(book, moved)), dim), f"{schema}, changed array<long>"))
        found = state.select("changed").mapInArrow(_summed, "at long, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        change = np.zeros(book.shape[0] * book.shape[1] * (book.shape[2] + 1), object)
        for r in found.collect():  # a row for each component of each entry
            change[r["at"]] = int(r["v"])
        sums = sums + change.reshape(*book.shape[:2], -1)
        new = book.copy()
        for p, j in np.argwhere(sums[:, :, -1] > 0):
            new[p, j] = [int(s) // int(sums[p, j, -1]) for s in sums[p, j, :-1]]
        book, moved, state = new, _moved(book, new), state.drop("changed")
    coded = cut(state.mapInArrow(_coded(context.broadcast(Books(book, moved)), dim), f"vec_id {id_kind}, label {label_kind}, code string, error long"))
    by_label = cut(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")))
    few = by_label.count() <= BROADCAST_LABELS
    by_label = by_label.withColumnRenamed("label", "of")
    # beyond that, a hot label's rows are a skewed side of a plain join, which Spark splits
    out = coded.join(F.broadcast(by_label) if few else by_label, F.col("label").eqNullSafe(F.col("of")))
    digest = hashlib.sha256(",".join(map(str, book.ravel())).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
