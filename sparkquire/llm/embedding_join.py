"""Exact cosine self-join of vectors by an epsilon grid order.

Unit vectors with cosine >= t are within eps = sqrt(2 - 2 t).  Distinct vectors are turned to
their leading principal directions (of all vectors), put in the lexicographic order of
their grid cells of side eps, and cut into blocks of neighbours in that sequence.  Intervals
of the sequence are joined recursively, first as rows of boxes by DataFrame joins, then
inside a pair of blocks: two intervals whose boxes lie further apart than eps are skipped.
A block's vectors are written once to the shared folder, where every pair reads them.
Leaves are compared by a matrix product; each vector gets its number of links and a root
of a spanning forest, so no list of links is ever written.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..storage import cut, shared_dir, store

BLOCK_ROWS = 8192
BLOCK_BYTES = 8 << 20
LEAF_ROWS = 256
FAN = 8
#: Principal directions that order the sequence, and those that bound its boxes.
CELL_DIMS, BOX_DIMS = 8, 12


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components in double precision (a null as nan) and the n+1 offsets of the rows;
    a null row has no components."""
    column = column.cast(pa.large_list(pa.float64()))
    n = np.array(pa.compute.fill_null(pa.compute.list_value_length(column), 0), dtype=np.int64)
    flat = column.drop_null().flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64), np.concatenate([[0], np.cumsum(n)])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A vector's class is the hash of its components; null if it links with nothing."""
    for batch in batches:
        flat, at = _vectors(batch["embedding"])
        flat = flat + 0.0  # -0.0 is 0.0
        with np.errstate(over="ignore", invalid="ignore"):
            good = np.isfinite(flat)
        cid = []
        for a, b in zip(at[:-1], at[1:]):
            v = flat[a:b]
            cid.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest() if b > a and good[a:b].all() and v.any() else None)
        yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(cid, pa.binary()), batch["embedding"]], ["vec_id", "cid", "embedding"])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each dimension in the batch."""
    flat, at = _vectors(batch["embedding"])
    size = np.diff(at)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, flat[(at[:-1][rows][:, None] + np.arange(d)[None, :])]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in _by_dimension(batch):
            y = np.concatenate([np.ones((len(x), 1)), _unit(x)], axis=1)
            sums[x.shape[1]] = sums.get(x.shape[1], 0) + y.T @ y
    for d, m in sums.items():
        i, j = np.triu_indices(d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), pa.array(m[i, j])], ["d", "i", "j", "v"])


def principal_directions(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension d, a d x BOX_DIMS basis from the moments of all its vectors.  The driver
    gets d * d sums.  A basis steers the order only: any orthonormal one gives the same links."""
    sums = vectors.select("embedding").mapInArrow(_moments, "d long, i long, j long, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    found: dict[int, np.ndarray] = {}
    for r in sums.toLocalIterator():
        m = found.setdefault(r.d, np.zeros((r.d + 1, r.d + 1)))
        m[r.i, r.j] = m[r.j, r.i] = r.v
    out = {}
    for d, m in found.items():
        mean = m[0, 1:] / m[0, 0]
        _, vectors_ = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
        basis = vectors_[:, ::-1][:, :BOX_DIMS]
        out[d] = np.concatenate([basis, np.zeros((d, BOX_DIMS - basis.shape[1]))], axis=1)
    return out


def _cells(basis, eps: float, kind: str):
    """Adds each vector's dimension, its grid cell (bytes that sort as the cells do), and its
    components as bytes of numpy type ``kind``, that of the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            dims, keys, raw = np.zeros(n, np.int64), [b""] * n, [b""] * n
            for rows, x in _by_dimension(batch):
                cell = np.floor(_unit(x) @ basis.value[x.shape[1]][:, :CELL_DIMS] / eps)
                cell = (np.clip(cell, -32768, 32767) + 32768).astype(">u2")
                dims[rows] = x.shape[1]
                for r, c, v in zip(rows, cell, x.astype(kind)):
                    keys[r], raw[r] = c.tobytes(), v.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(keys, pa.binary()), batch["cid"], batch["n"], pa.array(raw, pa.binary())], ["d", "cell", "cid", "n", "raw"])

    return run


def _blocks(basis, kind: str, folder: str):
    """Rows sorted by (b, d, place) to a row for each (b, d): its box and the file of its ids, weights and vectors.
    A retried task writes files of its own names, and only those of checkpointed rows are read."""

    def pack(b, d, held):
        raw = [h[2] for h in held]
        p = _unit(np.frombuffer(b"".join(raw), kind).reshape(-1, d)) @ basis.value[d]
        path = f"{folder}/{b}-{d}-{uuid.uuid4().hex}.arrow"
        system, place = store(path)
        table = pa.table([pa.array([h[0] for h in held], pa.binary()), pa.array([h[1] for h in held], pa.int64()), pa.array(raw, pa.binary())], ["cid", "n", "raw"])
        with system.open_output_stream(place) as out, pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        return pa.RecordBatch.from_pylist([{"b": b, "d": d, "low": p.min(axis=0).tolist(), "high": p.max(axis=0).tolist(), "path": path}], schema=BLOCK_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for b, d, *row in zip(*(batch[c].to_pylist() for c in ("b", "d", "cid", "n", "raw"))):
                if held and (b, d) != key:
                    yield pack(*key, held)
                    held = []
                key = (b, d)
                held.append(row)
        if held:
            yield pack(*key, held)

    return run


def _load(path: str, kind: str, d: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    system, place = store(path)
    with system.open_input_stream(place) as source:
        table = pa.ipc.open_stream(source).read_all()
    x = np.frombuffer(b"".join(table["raw"].to_pylist()), kind).reshape(-1, d)
    return table["cid"].to_pylist(), table["n"].to_numpy(), _unit(x)


BLOCK_ARROW = pa.schema([("b", pa.int64()), ("d", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("path", pa.string())])
BLOCK_ROW = "b long, d long, low array<double>, high array<double>, path string"


def interval_pairs(directory: DataFrame, blocks: int, eps: float) -> DataFrame:
    """(a, b), a <= b: block numbers whose boxes are within eps of each other, found by joining
    intervals of the sequence from the widest down.  directory: b, d, low, high."""
    bounds = [F.min("d_low").alias("d_low"), F.max("d_high").alias("d_high")]
    bounds += [f(c).alias(c) for f, s in ((F.min, "l"), (F.max, "h")) for c in (f"{s}{i}" for i in range(BOX_DIMS))]
    leaves = directory.select("b", F.col("d").alias("d_low"), F.col("d").alias("d_high"), *(F.col(n)[i].alias(f"{s}{i}") for s, n in (("l", "low"), ("h", "high")) for i in range(BOX_DIMS)))
    levels = max(1, math.ceil(math.log(max(blocks, 2), FAN)))
    pairs = None
    for level in range(levels - 1, -1, -1):
        width = FAN**level
        nodes = leaves.groupBy(F.floor(F.col("b") / width).cast("long").alias("node")).agg(*bounds).withColumn("up", F.floor(F.col("node") / FAN).cast("long"))
        x, y = nodes.alias("x"), nodes.alias("y")
        gap = reduce(lambda s, t: s + t, (F.pow(F.greatest(F.lit(0.0), F.col(f"x.l{i}") - F.col(f"y.h{i}"), F.col(f"y.l{i}") - F.col(f"x.h{i}")), 2) for i in range(BOX_DIMS)))
        near = (F.col("x.node") <= F.col("y.node")) & (F.col("x.d_low") <= F.col("y.d_high")) & (F.col("y.d_low") <= F.col("x.d_high")) & (gap <= eps * eps + 1e-9)
        if pairs is None:  # the widest intervals, FAN of them at most, are all below one
            pairs = x.join(y, (F.col("x.up") == F.col("y.up")) & near)
        else:
            pairs = pairs.join(x, F.col("a") == F.col("x.up")).join(y, (F.col("b") == F.col("y.up")) & near)
        pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return pairs


def join_blocks(x: np.ndarray, y: np.ndarray, same: bool, basis: np.ndarray, t: float, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of x and then of y (with ``same``: of x): weights of their links, and the
    first row that links within this pair of blocks join them to."""
    eps2 = 2 - 2 * t + 1e-9
    m, shift = len(x) if same else len(x) + len(y), 0 if same else len(x)
    count, root = np.zeros(m, np.int64), np.arange(m)
    x32, y32, px, py = x.astype(np.float32), y.astype(np.float32), x @ basis, y @ basis
    margin = 1e-6 + 2e-7 * x.shape[1]  # of the single-precision product

    def far(a0, a1, b0, b1):
        gap = np.maximum(0, np.maximum(px[a0:a1].min(0) - py[b0:b1].max(0), py[b0:b1].min(0) - px[a0:a1].max(0)))
        return float(gap @ gap) > eps2

    def leaf(a0, a1, b0, b1):
        s = x32[a0:a1] @ y32[b0:b1].T
        i, j = np.nonzero(s >= t - margin)
        if same:
            i, j = i[i + a0 < j + b0], j[i + a0 < j + b0]
        unsure = np.flatnonzero(s[i, j] < t + margin)
        keep = np.ones(len(i), bool)
        for c in range(0, len(unsure), 1 << 15):
            u = unsure[c : c + (1 << 15)]
            keep[u] = np.einsum("ij,ij->i", x[i[u] + a0], y[j[u] + b0]) >= t
        i, j = i[keep] + a0, j[keep] + b0
        if not len(i):
            return
        np.add.at(count, i, ny[j])
        np.add.at(count, j + shift, nx[i])
        j = j + shift
        while True:
            ri, rj = root[i], root[j]
            if (ri == rj).all():
                return
            least = np.minimum(ri, rj)
            np.minimum.at(root, ri, least)
            np.minimum.at(root, rj, least)
            while (root[root] != root).any():
                root[:] = root[root]

    def recurse(a0, a1, b0, b1):
        if (same and b1 <= a0) or far(a0, a1, b0, b1):
            return
        if a1 - a0 <= LEAF_ROWS and b1 - b0 <= LEAF_ROWS:
            return leaf(a0, a1, b0, b1)
        am, bm = (a0 + a1) // 2, (b0 + b1) // 2
        for p, q in ((a0, am), (am, a1)) if a1 - a0 > LEAF_ROWS else ((a0, a1),):
            for r, s in ((b0, bm), (bm, b1)) if b1 - b0 > LEAF_ROWS else ((b0, b1),):
                recurse(p, q, r, s)

    if len(x) and len(y):
        recurse(0, len(x), 0, len(y))
    return count, root


def _joined(basis, t: float, kind: str):
    """Rows of two blocks' files to the links and roots of their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, p, q in zip(*(batch[c].to_pylist() for c in ("d", "p", "q"))):
                ids, nx, x = _load(p, kind, d)
                other, ny, y = ([], nx, x) if p == q else _load(q, kind, d)
                count, root = join_blocks(x, y, p == q, basis.value[d], t, nx, ny)
                ids, some = ids + other, np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in some], pa.binary()), pa.array(count[some]), pa.array([ids[root[i]] for i in some], pa.binary())], ["cid", "links", "root"])

    return run


def cosine_components(vectors: DataFrame, t: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors link where their cosine in double precision is t or more (0 < t < 1); equal
    vectors always do.  Vectors that are null, empty, zero or hold a null or non-finite
    component link with nothing, and vectors of different lengths never link.  component_id
    is the smallest vec_id reachable, itself included; kept means vec_id = component_id.
    """
    if not 0 < t < 1:
        raise ValueError("the least cosine must lie between 0 and 1")
    spark, eps = vectors.sparkSession, math.sqrt(2 - 2 * t)
    base = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    named = base.mapInArrow(_named, f"vec_id {kinds['vec_id']}, cid binary, embedding {kinds['embedding']}")
    classes = cut(named.where("cid is not null").groupBy("cid").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding")))
    basis = spark.sparkContext.broadcast(principal_directions(classes))
    kind = "<f4" if kinds["embedding"] == "array<float>" else "<f8"
    cells = classes.select("cid", "n", "embedding").mapInArrow(_cells(basis, eps, kind), "d long, cell binary, cid binary, n long, raw binary")
    ordered = cells.repartitionByRange("d", "cell", "cid").sortWithinPartitions("d", "cell", "cid")
    ordered = cut(ordered.select("d", "cid", "n", "raw", F.monotonically_increasing_id().alias("at")))  # partition * 2**33 + row
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    ahead, total = [], 0
    for part, n in sorted(tuple(r) for r in ordered.groupBy("part").count().collect()):  # a row for each partition
        ahead.append((part, total))
        total += n
    offsets = spark.createDataFrame(ahead or [(0, 0)], "part long, ahead long")
    widest = max(basis.value, default=1)
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * widest)))
    place = F.col("ahead") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ordered.join(F.broadcast(offsets), "part").withColumn("place", place).withColumn("b", F.floor(F.col("place") / rows).cast("long"))
    folder = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    system, held = store(folder)
    system.create_dir(held, recursive=True)
    blocks = cut(placed.repartition("b").sortWithinPartitions("b", "d", "place").select("b", "d", "cid", "n", "raw").mapInArrow(_blocks(basis, kind, folder), BLOCK_ROW))
    near = interval_pairs(blocks.select("b", "d", "low", "high"), math.ceil(total / rows), eps)
    x, y = blocks.select(F.col("b").alias("a"), "d", F.col("path").alias("p")), blocks.select("b", "d", F.col("path").alias("q"))
    pairs = cut(near.join(x, "a").join(y, ["b", "d"]).select("d", "p", "q"))
    n = pairs.count()
    if n:  # rows of two names stand for much work: they are dealt by number, not by size
        pairs = pairs.repartition(min(n, 8 * spark.sparkContext.defaultParallelism), "p", "q")
    found = cut(pairs.mapInArrow(_joined(basis, t, kind), "cid binary, links long, root binary"))
    system.delete_dir(held)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(found.where("cid <> root").select("cid", "root"), "cid", "root")
    rooted = classes.select("cid", "least", "n").join(links, "cid", "left").join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("top", F.coalesce("component", "cid"))
    tops = rooted.groupBy("top").agg(F.min("least").alias("component_id"))
    known = rooted.join(tops, "top").select("cid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = named.select("vec_id", "cid").join(known, "cid", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
