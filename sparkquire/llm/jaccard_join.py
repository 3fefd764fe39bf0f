"""Exact Jaccard self-join of word-shingle sets by PartEnum signatures.

Equal sets are one class, and one member of each class is signed.  Sizes fall into bands; within a band, and across two
neighbouring ones, sets of the wanted similarity differ in at most k features.  Features
are hashed into k + 1 + e partitions, so such sets agree in 1 + e of them at least.  Each set
leaves out its e smallest partitions (by size, then number) and signs every other with its
content: the largest of the agreeing partitions is never among the e smallest of either
set, so the two always share a signature, and no signature stands on a few common words.

Sets that share a signature are linked to the least set of that signature (never all
pairs); their components are the families within which pairs are verified.  A large family is
cut into blocks of bounded size by set size; each block is written once to the shared folder,
pairs of blocks that aren't too far apart in size read the two from there, and a pair is
verified at once by a product of 0/1 matrices, which returns a spanning forest of the links,
not the links.

Chance meetings chain sets of nothing in common into one family that grows faster than the input.  So a large family
is parted first: the members of each signature are compared by sketches, a parity bit for each of some hash slots.  The bits
in which two sketches differ are never more than the features in which the sets do, so sets that are linked always stay together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import give_back, mix, shingle_sets
from .sieve import Sieve
from ..operators.components import components
from ..storage import cut, modest_batches, release, shared_dir, store

BAND_RATIO = 1.5
BLOCK_SETS = 512
BLOCK_SHINGLES = 600_000
FEATURES_AT_ONCE = 4096
#: Classes that a task remembers as signed, and meetings that it remembers as told.
SIGNED_CLASSES = 500_000
#: Members of one signature that are compared with one another by sketches; more stay one family.
SKETCHED = 4096


class Bands:
    """Instances of PartEnum for sizes up to ``most`` and one band above, so that every size has
    a seam above it: own bands have even numbers, the seams between bands i and i + 1 have odd
    ones.  num/den is the least similarity."""

    def __init__(self, num: int, den: int, most: int = 2**31 - 1):
        ratio, low, self.low, self.high = max(BAND_RATIO, 1.2 * den / num), 1, [], []
        while len(self.high) < 2 or self.high[-2] < most:
            self.low.append(low)
            self.high.append(int(np.ceil(low * ratio)))
            low = self.high[-1] + 1
        self.lows, self.highs = np.array(self.low), np.array(self.high)
        k_own = [(den - num) * 2 * r // (den + num) for r in self.high]
        k_seam = [(den - num) * (r + r * den // num) // (den + num) for r in self.high]
        self.k = np.array([k for pair in zip(k_own, k_seam) for k in pair])
        self.num, self.den = num, den

    def roles(self, sizes: np.ndarray) -> list[np.ndarray]:
        """For own band, seam above and seam below: each set's instance, or -1."""
        band = np.searchsorted(self.highs, sizes)
        own = np.where(sizes > 0, 2 * band, -1)
        above = self.lows[band + 1]
        upper = np.where((sizes > 0) & (sizes * self.den >= above * self.num), 2 * band + 1, -1)
        below = np.where(band > 0, self.highs[np.maximum(band - 1, 0)], 0)
        lower = np.where((sizes > 0) & (sizes * self.num <= below * self.den), 2 * band - 1, -1)
        return [own, upper, lower]

    def signatures(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of the sets whose features stand one after another in x, and the
        set's number of each."""
        out, of = [], []
        for inst in self.roles(sizes):
            k = np.where(inst >= 0, self.k[np.maximum(inst, 0)], 0)
            use = k > 0  # with k = 0 only equal sets are similar enough
            spare = 1 + k // 8
            parts = np.where(use, k + 1 + spare, 0)
            base = np.cumsum(parts) - parts
            total = int(parts.sum())
            if not total:
                continue
            row = np.repeat(np.arange(len(sizes)), sizes)
            mine = use[row]
            row, y = row[mine], mix(x[mine] + np.uint64(0xD6E8FEB86659FD93) * (inst[row[mine]] + 1).astype(np.uint64))
            slot = base[row] + ((y >> np.uint64(33)).astype(np.int64) % parts[row])
            y = mix(y)
            count = np.bincount(slot, minlength=total)
            low = np.bincount(slot, weights=(y & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=total).astype(np.uint64)
            high = np.bincount(slot, weights=(y >> np.uint64(32)).astype(np.float64), minlength=total).astype(np.uint64)
            owner = np.repeat(np.arange(len(sizes)), parts)
            part = np.arange(total) - base[owner]
            rank = np.empty(total, np.int64)
            rank[np.argsort(owner * (int(count.max()) + 1) + count, kind="stable")] = np.arange(total)
            keep = rank - base[owner] >= spare[owner]
            sig = mix(low + mix(high + mix(count.astype(np.uint64) + (part.astype(np.uint64) << np.uint64(24)) + (inst[owner].astype(np.uint64) << np.uint64(52)))))
            out.append(sig[keep])
            of.append(owner[keep])
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(out), np.concatenate(of)


def class_hashes(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; 0 for an empty one."""
    some = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[some]
    out = []
    for seed in (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35):
        h = np.zeros(len(sizes), np.uint64)
        if some.any():
            h[some] = mix(np.add.reduceat(mix(x ^ np.uint64(seed)), starts) + sizes[some].astype(np.uint64))
        out.append(h)
    return out[0], out[1]


def sketches(x: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """Parity bits of each set: of its features in each of as many hash slots as it has features, up to a power of two (64 at least)."""
    slots = np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    ends = np.cumsum(slots)
    at = np.repeat(ends - slots, sizes) + (mix(x ^ np.uint64(0x2545F4914F6CDD1D)) & (np.repeat(slots, sizes) - 1).astype(np.uint64)).astype(np.int64)
    data = np.packbits(np.bincount(at, minlength=int(slots.sum())).astype(np.uint8) & 1, bitorder="little").tobytes()
    return [data[(e - s) // 8 : e // 8] if n else None for e, s, n in zip(ends.tolist(), slots.tolist(), sizes.tolist())]


def possible_roots(told: list[bytes], sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each set the first one that it is joined to by pairs that their sketches allow to be links.  A longer sketch is
    folded to the length of the other."""
    m, width = len(told), np.array([len(t) for t in told])
    links = np.zeros((m, m), bool)
    for w in np.unique(width):
        rows, others = np.flatnonzero(width == w), np.flatnonzero(width >= w)
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(told[i], np.uint64).reshape(-1, w // 8), axis=0) for i in others])
        own = folded[np.searchsorted(others, rows)]
        step = max(1, (4 << 20) // folded.nbytes)
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            apart = np.bitwise_count(own[a : a + step, None] ^ folded[None]).sum(axis=2, dtype=np.int64)
            links[np.ix_(part, others)] = apart * (num + den) <= (sizes[part, None] + sizes[None, others]) * (den - num)
    return _roots(links | links.T)


def _roots(links: np.ndarray) -> np.ndarray:
    """The first node that each reaches by links, a symmetric matrix."""
    m = len(links)
    np.fill_diagonal(links, True)
    root = np.arange(m)
    while True:
        near = np.where(links, root[None, :], m).min(axis=1)
        near = np.minimum(near, near[near])
        if (near == root).all():
            return root
        root = near


def link_roots(sets: list[np.ndarray], blocks: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each set the first one that it is joined to by links (itself if none).  With two
    blocks only pairs across them are looked at: each block has its own turn."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    if m == 2:
        inter = np.array([[0, np.intersect1d(*sets, assume_unique=True).size]] * 2)
        inter[1] = inter[1][::-1]
    else:
        _, feature, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), sizes)
        shared = np.flatnonzero(count > 1)
        number = np.full(len(count), -1)
        number[shared] = np.arange(len(shared))
        column, inter = number[feature], np.zeros((m, m), np.float32)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        for first in range(0, len(shared), FEATURES_AT_ONCE):
            a, b = np.searchsorted(column, [first, first + FEATURES_AT_ONCE])
            x = np.zeros((m, min(FEATURES_AT_ONCE, len(shared) - first)), np.float32)
            x[row[a:b], column[a:b] - first] = 1
            inter += x @ x.T
        inter = inter.astype(np.int32)
    links = inter * (num + den) >= num * (sizes[:, None] + sizes[None, :])
    if len(np.unique(blocks)) == 2:
        links &= blocks[:, None] != blocks[None, :]
    return _roots(links)


def _class_rows(num: int, den: int, k: int):
    """Each row's class, and the signatures of the class where a task meets it first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, signed = Bands(num, den), set()  # the bands are the same in every task, whatever sizes it sees
        for batch in batches:
            for first, x, _, sizes in shingle_sets(batch["text"], k):
                c1, c2 = class_hashes(x, sizes)
                both = np.stack([c1, c2], axis=1).tobytes()
                cids = [both[16 * i : 16 * i + 16] if n else None for i, n in enumerate(sizes.tolist())]
                if len(signed) > SIGNED_CLASSES:
                    signed.clear()
                new = np.zeros(len(sizes), bool)
                for i, c in enumerate(cids):
                    if c is not None and c not in signed:
                        signed.add(c)
                        new[i] = True
                sig, of = bands.signatures(x[np.repeat(new, sizes)], sizes[new])
                order = np.argsort(of, kind="stable")
                ends = np.zeros(len(sizes) + 1, np.int32)
                ends[1:][new] = np.bincount(of, minlength=int(new.sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends).astype(np.int32)), pa.array(sig[order].view(np.int64)))
                own = batch.slice(first, len(sizes))
                yield pa.RecordBatch.from_arrays([own["doc_id"], own["rid"], pa.array(sizes.astype(np.int64)), pa.array(c1.view(np.int64)), pa.array(cids, pa.binary()), lists, pa.array(new), _told(x, sizes, new)], ["doc_id", "rid", "n", "c1", "cid", "sigs", "signs", "sketch"])
        give_back()

    return run


def _told(x: np.ndarray, sizes: np.ndarray, new: np.ndarray) -> pa.Array:
    """The sketches of new classes, null for others."""
    own = iter(sketches(x[np.repeat(new, sizes)], sizes[new]))
    return pa.array([next(own) if w else None for w in new], pa.binary())


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, c1): of each signature with several members, each with the first; k1 and k2 name the members, and a task
    gives the same members once."""
    told: set[tuple[int, int]] = set()

    def found(sig: np.ndarray, c1: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(start, len(sig)))
        k1, k2 = (np.add.reduceat(mix(c1.view(np.uint64) ^ np.uint64(seed)), start).view(np.int64) for seed in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))
        new = size > 1
        for i in np.flatnonzero(new).tolist():
            if len(told) > SIGNED_CLASSES:
                told.clear()
            key = (int(k1[i]), int(k2[i]))
            new[i] = key not in told
            told.add(key)
        rows = np.repeat(new, size)
        of = np.repeat(np.arange(len(start)), size)[rows]
        return pa.RecordBatch.from_arrays([pa.array(k1[of]), pa.array(k2[of]), pa.array(c1[start[of]]), pa.array(c1[rows])], ["k1", "k2", "a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of a signature that may go on
    for batch in batches:
        sig, c1 = batch["sig"].to_numpy(), batch["c1"].to_numpy()
        if not len(sig):
            continue
        last = int(np.searchsorted(sig, sig[-1]))
        if held and (last or held[0][0][0] != sig[-1]):
            yield found(*(np.concatenate(c) for c in zip(*held, (sig[:last], c1[:last]))))
            held = []
        elif last:
            yield found(sig[:last], c1[:last])
        held.append((sig[last:], c1[last:]))
    if held:
        yield found(*(np.concatenate(c) for c in zip(*held)))


def _possible(num: int, den: int):
    """Rows sorted by (k1, k2): members of one signature that sketches allow to be linked, each with the first of them."""

    def finish(held: list[tuple[int, int, bytes]]) -> tuple[list[int], list[int]]:
        c1, sizes, told = zip(*held)
        root = possible_roots(list(told), np.array(sizes), num, den) if len(held) <= SKETCHED else np.zeros(len(held), int)
        some = np.flatnonzero(root != np.arange(len(held))).tolist()
        return [c1[root[i]] for i in some], [c1[i] for i in some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            a, b = [], []
            for k1, k2, *row in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "c1", "n", "sketch"))):
                if last is not None and last != (k1, k2):
                    x, y = finish(held)
                    a, b, held = a + x, b + y, []
                last = (k1, k2)
                held.append(tuple(row))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in finish(held)], ["a", "b"])

    return run


def _set_rows(sieve: Sieve, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(sieve.passes(batch["rid"].to_numpy())))
            for first, x, _, sizes in shingle_sets(part["text"], k):
                data, ends = x.tobytes(), np.cumsum(sizes) * 8
                packed = pa.array([data[e - 8 * n : e] for e, n in zip(ends, sizes)], pa.binary())
                yield pa.RecordBatch.from_arrays([part["rid"].slice(first, len(sizes)), packed], ["rid", "features"])
        give_back()

    return run


EDGES = "block long, path string, a binary, b binary"


def _edge_batch(block: int | None, path: str | None, a: list, b: list) -> pa.RecordBatch:
    """Edges of a block, and a row of its path if it was written."""
    n = len(a) + (path is not None)
    return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([path] * n if path else [None] * n, pa.string()), pa.array(a + [None] * (n - len(a)), pa.binary()), pa.array(b + [None] * (n - len(b)), pa.binary())], ["block", "path", "a", "b"])


def _forest(cids: list[bytes], sets: list[np.ndarray], blocks: np.ndarray, num: int, den: int) -> tuple[list, list]:
    if len(sets) < 2:
        return [], []
    found = link_roots(sets, blocks, num, den)
    some = np.flatnonzero(found != np.arange(len(sets)))
    return [cids[i] for i in some], [cids[found[i]] for i in some]


def _within_blocks(num: int, den: int, folder: str):
    """Rows sorted by block: the forest of each block, and the file of each one of a large family."""

    def finish(block: int, large: bool, held: dict[bytes, bytes]) -> pa.RecordBatch:
        cids, path = list(held), None
        if large:
            path = f"{folder}/{block & (2**64 - 1):016x}-{uuid.uuid4().hex}.arrow"
            system, place = store(path)
            table = pa.table({"cid": pa.array(cids, pa.binary()), "features": pa.array(list(held.values()), pa.binary())})
            with system.open_output_stream(place) as out, pa.ipc.new_stream(out, table.schema) as writer:
                writer.write_table(table)
        a, b = _forest(cids, [np.frombuffer(x, np.uint64) for x in held.values()], np.zeros(len(cids)), num, den)
        return _edge_batch(block, path, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for batch in batches:
            for i in range(len(batch)):
                block, large, cid, features = (batch[c][i].as_py() for c in ("block", "large", "cid", "features"))
                if last is not None and block != last[0]:
                    yield finish(*last, held)
                    held = {}
                last = (block, large)
                held[cid] = features  # rows that repeat a whole document come twice
        if last is not None:
            yield finish(*last, held)

    return run


def _across_blocks(num: int, den: int):
    """Rows of two blocks' files: the forest of the links from one to the other."""

    def load(path: str) -> tuple[list[bytes], list[np.ndarray]]:
        system, place = store(path)
        with system.open_input_stream(place) as source:
            table = pa.ipc.open_stream(source).read_all()
        return table["cid"].to_pylist(), [np.frombuffer(x, np.uint64) for x in table["features"].to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q in zip(batch["p"].to_pylist(), batch["q"].to_pylist()):
                (c0, s0), (c1, s1) = load(p), load(q)
                yield _edge_batch(None, None, *_forest(c0 + c1, s0 + s1, np.repeat([0, 1], [len(s0), len(s1)]), num, den))

    return run


def _large() -> Column:
    return (F.count("*") > BLOCK_SETS) | (F.sum("n") > BLOCK_SHINGLES)


def _parted(members: DataFrame, meetings: DataFrame, told: DataFrame, num: int, den: int) -> DataFrame:
    """members (cid, rid, n, c1, family) with large families parted; members that nothing can be linked with go.
    A signature's members are all of one family, so what meets in a large one meets there whole."""
    large = cut(members.groupBy("family").agg(_large().alias("large")).where("large").select("family"))
    if large.isEmpty():
        return members
    known = cut(members.join(large.withColumn("large", F.lit(True)), "family", "left"))
    inside = known.where("large").select("cid", "rid", "n", "c1")
    rows = meetings.select("k1", "k2", F.col("b").alias("c1")).distinct().join(told.join(inside.select("cid"), "cid", "left_semi").dropDuplicates(["cid"]), "c1")
    edges = rows.select("k1", "k2", "c1", "n", "sketch").repartition("k1").sortWithinPartitions("k1", "k2").mapInArrow(_possible(num, den), "a long, b long")
    found = components(edges).select(F.col("node").alias("c1"), F.col("component").alias("family"))
    return cut(known.where("large is null").drop("large").unionByName(inside.join(found, "c1")))


def _block_rows(members: DataFrame, num: int, den: int) -> DataFrame:
    """(rid, cid, family, bin, salt, block, large): each class in its block.  A family that fits one
    block is one; others go by size (a bin spans the greatest ratio of linked sizes) and, where a
    bin is too full, by a hash."""
    whole = members.groupBy("family").agg(_large().alias("large"))
    size_bin = F.floor(F.ln("n") / F.ln(F.lit(den / num)) + 1e-9).cast("long")
    members = members.join(whole, "family").withColumn("bin", F.when(F.col("large"), size_bin).otherwise(0))
    bins = members.groupBy("family", "bin").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("salts"))
    placed = members.join(bins, ["family", "bin"]).withColumn("salt", F.pmod(F.xxhash64("cid"), "salts"))
    return placed.select("rid", "cid", "family", "bin", "salt", F.xxhash64("family", "bin", "salt").alias("block"), "large")


def _block_links(placed: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): a forest of the links of all blocks and pairs of blocks, checkpointed."""
    spark = placed.sparkSession
    folder = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    system, place = store(folder)
    system.create_dir(place, recursive=True)
    rows = placed.join(sets, "rid").select("block", "large", "cid", "features")
    within = cut(rows.repartition("block").sortWithinPartitions("block").mapInArrow(_within_blocks(num, den, folder), EDGES))
    release(spark)
    files = within.where("path is not null and a is null").select("block", "path")
    blocks = placed.where("large").select("family", "bin", "salt", "block").distinct().join(files, "block")
    x, y = blocks.alias("x"), blocks.alias("y")
    near = (F.col("x.family") == F.col("y.family")) & (F.abs(F.col("x.bin") - F.col("y.bin")) <= 1) & (F.col("x.block") < F.col("y.block"))
    pairs = cut(x.join(y, near).select(F.col("x.path").alias("p"), F.col("y.path").alias("q")))
    n = pairs.count()
    links = within.where("a is not null").select("a", "b")
    if n:  # rows of two names stand for much work: they are dealt by number, not by size
        dealt = pairs.repartition(min(n, 8 * spark.sparkContext.defaultParallelism), "p", "q")
        links = links.union(cut(dealt.mapInArrow(_across_blocks(num, den), EDGES)).select("a", "b"))
    system.delete_dir(place)
    return links


def _rooted(docs: DataFrame, num: int, den: int, words: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, rid, n, cid, root) of every row: rid a hash of id and text, root the same for all rows
    that links join, null for a row without words."""
    spark = docs.sparkSession
    modest_batches(spark)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    rows = cut(base.select("doc_id", "rid", "text").mapInArrow(_class_rows(num, den, words), f"doc_id {kind}, rid long, n long, c1 long, cid binary, sigs array<long>, signs boolean, sketch binary"))
    # a class comes from a task once, and from all of them once after this
    signing = rows.where("signs and size(sigs) > 0").select("cid", "c1", "sigs").dropDuplicates(["cid"])
    signed = signing.select("c1", F.explode("sigs").alias("sig"))
    meetings = cut(signed.repartition("sig").sortWithinPartitions("sig", "c1").mapInArrow(_meetings, "k1 long, k2 long, a long, b long"))
    del signing, signed
    release(spark)  # the signatures' shuffles
    families = components(meetings).select(F.col("node").alias("c1"), F.col("component").alias("family"))
    classes = rows.where("cid is not null").groupBy("cid", "c1").agg(F.min("rid").alias("rid"), F.min("n").alias("n"))
    members = cut(classes.join(families, "c1").select("cid", "rid", "n", "c1", "family"))
    told = rows.where("signs and sketch is not null").select("cid", "c1", "n", "sketch")
    members = _parted(members, meetings, told, num, den)
    release(spark)
    sieve = Sieve(members.select(F.col("rid").alias("key")))
    sets = base.select("rid", "text").mapInArrow(_set_rows(sieve, words), "rid long, features binary")
    joined = components(_block_links(cut(_block_rows(members, num, den)), sets, num, den)).select(F.col("node").alias("cid"), F.col("component").alias("root"))
    return rows.select("doc_id", "rid", "n", "cid").join(joined, "cid", "left").select("doc_id", "rid", "n", "cid", F.coalesce("root", "cid").alias("root"))


def jaccard_components(docs: DataFrame, num: int = 80, den: int = 100, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    A row's set is its distinct ``words``-word shingles of A-Z-lowered words between ASCII
    spaces; a text of fewer words has its whole sequence as one.  Rows whose sets have
    den * intersection >= num * union are linked, and component_id is the smallest doc_id that
    links reach (nulls aside).  A row without words (null, empty, blank) links with nothing:
    its component is its own id.  Repeated rows each give a row; extra columns are ignored.
    """
    rows = cut(_rooted(docs, num, den, words, doc_id, text))
    # cut: else the aggregate would share the exchange of the join, which could not split a large component
    least = cut(rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).where("copies > 1").select("root", "least"))
    return rows.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def repeats(docs: DataFrame, num: int = 80, den: int = 100, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """What goes so that one row of each component stays, as two frames of (key, doc_id), key being
    xxhash64(doc_id, text): the rows that aren't the least (doc_id, key) of their component, and the
    kept ones that stand in ``docs`` more than once.  Rows without words or without an id are in
    neither: they all stay."""
    rows = cut(_rooted(docs, num, den, words, doc_id, text).where("root is not null and doc_id is not null").groupBy("root", "doc_id", "rid").agg(F.count("*").alias("copies")))
    kept = cut(rows.groupBy("root").agg(F.min(F.struct("doc_id", "rid")).alias("best"), F.count("*").alias("n")).where("n > 1"))
    known = rows.join(kept, "root", "left").withColumn("stays", F.col("best").isNull() | (F.struct("doc_id", "rid").eqNullSafe(F.col("best"))))
    known = cut(known.where("not stays or copies > 1").select(F.col("rid").alias("key"), "doc_id", "stays"))
    return known.where("not stays").select("key", "doc_id"), known.where("stays").select("key", "doc_id")
