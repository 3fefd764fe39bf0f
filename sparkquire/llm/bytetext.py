"""Whole texts of an Arrow batch as one byte buffer, tokenised and hashed by numpy.

Nothing here loops over words or characters in Python: a batch of texts is one ``uint8``
buffer with offsets, and words are spans found from a 256-entry class table.  A span's hash
takes eight bytes a step through a mixing function, so that spans of up to eight bytes never
collide with others of their length and longer ones do by chance alone (2**-64 a pair); no
family of texts collides by its structure, as it would under a polynomial modulo 2**64.

Work is done in pieces of about PIECE_BYTES: short texts share one, and a longer text comes in
several, cut between its words, so that temporaries are bounded whatever a text's length.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Space and \t \n \v \f \r separate words; every other byte belongs to one.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
IS_LINE_END = np.zeros(256, bool)
IS_LINE_END[[10, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] = LOWER[97:123]
#: Bytes of one piece: temporaries take about 40 bytes for each.
PIECE_BYTES = 600_000
#: Bytes of a span that are hashed by steps of eight; longer ones go through BLAKE2.
STEPPED = 256
#: Words of a long text whose shingles are made at once.
SHINGLES_AT_ONCE = 500_000
_ODD, _STEP, _HORNER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x2545F4914F6CDD1D)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; a null text is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return body, at - (at[0] if n else 0)


@dataclass
class Piece:
    """Bytes of ``rows`` texts from row ``first`` on, or (``part`` > 0, or ``more``) a part of one long text."""

    first: int
    rows: int
    body: np.ndarray
    offsets: np.ndarray
    part: int = 0
    more: bool = False


def pieces(column: pa.Array, between: np.ndarray = IS_SPACE, most: int | None = None) -> Iterator[Piece]:
    """All rows of the column, about ``most`` bytes at a time.  A longer text is cut behind a line's
    end, or else behind a byte of ``between``; a longer word is never cut."""
    body, offsets = column_bytes(column)
    most, n, first = most or PIECE_BYTES, len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        at, end = int(offsets[first]), int(offsets[last])
        if last > first + 1 or end - at <= most:
            yield Piece(first, last - first, body[at:end], offsets[first : last + 1] - at)
        else:
            part = 0
            while at < end:
                cut = _cut(body, at, min(at + most, end), end, between)
                yield Piece(first, 1, body[at:cut], np.array([0, cut - at]), part, cut < end)
                at, part = cut, part + 1
        first = last


def _cut(body: np.ndarray, at: int, near: int, end: int, between: np.ndarray) -> int:
    """The last place up to ``near`` behind a line's end or a separator, or the first one beyond."""
    if near >= end:
        return end
    for kind in (IS_LINE_END, between):
        found = np.flatnonzero(kind[body[at:near]])
        if len(found):
            return at + int(found[-1]) + 1
    for a in range(near, end, 1 << 20):
        found = np.flatnonzero(between[body[a : min(a + (1 << 20), end)]])
        if len(found):
            return a + int(found[0]) + 1
    return end


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(body: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes not in ``between``), and each text's number of words."""
    inside = ~between[body]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(body)]
    begins[edges] = inside[edges]  # a word never runs over from the text before
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = inside[last]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


class SpanHashes:
    """64-bit hashes of spans of one buffer, the same wherever a span stands; A-Z as a-z."""

    def __init__(self, body: np.ndarray):
        self.low = np.concatenate([LOWER[body], np.zeros(8, np.uint8)])
        self.eights = np.lib.stride_tricks.sliding_window_view(self.low, 8)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = ends - starts
        h = mix(length.astype(np.uint64) * _ODD + np.uint64(1))
        live, at, left = np.flatnonzero(length <= STEPPED), starts, length
        if len(live) < len(starts):
            at, left = starts[live], length[live]
        while len(live):
            some = left > 0
            if not some.all():
                live, at, left = live[some], at[some], left[some]
                if not len(live):
                    break
            chunk = self.eights[at].view("<u8")[:, 0] & _MASKS[np.minimum(left, 8)]
            h[live] = mix(h[live] ^ (chunk * _STEP))
            at, left = at + 8, left - 8
        for i in np.flatnonzero(length > STEPPED).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.low[starts[i] : ends[i]].data, digest_size=8).digest(), "little")
        return h


def _first_occurrences(x: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return x[new], row[new]


def _run(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each place on."""
    x = h[at]
    for j in range(1, k):
        x = x * _HORNER + h[at + j]
    return mix(x + np.uint64(k * int(_ODD) & (2**64 - 1)))


def _long_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of one text's words, some at a time."""
    n = len(h)
    if n < k:
        return _run(h, np.zeros(1, np.int64), n) if n else h
    found = [np.unique(_run(h, np.arange(a, min(a + SHINGLES_AT_ONCE, n - k + 1)), k)) for a in range(0, n - k + 1, SHINGLES_AT_ONCE)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows of the column: first row, sorted distinct shingle hashes of all its
    rows one after another, their row within the run, and the size of each row's set.

    A text of fewer than ``k`` words has its whole word sequence as one shingle; a
    text without words has none.
    """
    held: list[np.ndarray] = []
    for p in pieces(column):
        starts, ends, counts = word_spans(p.body, p.offsets)
        h = SpanHashes(p.body)(starts, ends)
        if p.more or p.part:
            held.append(h)
            if not p.more:
                x = _long_set(np.concatenate(held), k)
                held = []
                yield p.first, x, np.zeros(len(x), np.int64), np.array([len(x)])
            continue
        first = np.cumsum(counts) - counts
        into = np.arange(len(h)) - np.repeat(first, counts)
        at = np.flatnonzero(into + k <= np.repeat(counts, counts))
        x, row = [_run(h, at, k)], [np.repeat(np.arange(p.rows), np.maximum(counts - k + 1, 0))]
        for n in range(1, k):  # texts of fewer words
            short = np.flatnonzero(counts == n)
            if len(short):
                x.append(_run(h, first[short], n))
                row.append(short)
        x, row = _first_occurrences(np.concatenate(x), np.concatenate(row))
        yield p.first, x, row, np.bincount(row, minlength=p.rows)


def give_back() -> None:
    """Returns freed memory to the system at a task's end: workers are reused, and what one
    stage has held would otherwise stand beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # no glibc: its allocator decides
        pass
