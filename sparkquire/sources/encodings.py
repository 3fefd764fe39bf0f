"""Which encoding bytes without a mark are in, by the likelihood of their byte pairs.

Tables are learnt from texts at hand: each text is encoded in every encoding and its pairs of neighbouring bytes are
counted where it is, those at even places apart from those at odd ones (which tells the two orders of UTF-16 apart); what
meets are at most 131,072 counts an encoding.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is told apart where neither a mark nor a strict decoding decides.
ENCODINGS = ("gb18030", "big5", "shift_jis", "utf-16-le", "utf-16-be", "cp1252")
PAIRS = 2 << 16
#: Bytes that are looked at at once, and of which one text is encoded at once.
SLICE_BYTES = 1 << 20


def _pairs(data: bytes) -> np.ndarray:
    """How often each pair of neighbouring bytes stands at even places of the data, then at odd ones."""
    out = np.zeros(PAIRS, np.int64)
    for a in range(0, max(len(data) - 1, 0), SLICE_BYTES):
        codes = _codes(data[a : a + SLICE_BYTES + 1])
        out += np.bincount(codes ^ ((a & 1) << 16), minlength=PAIRS)
    return out


def _seen(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that the data has, and how often: short data is not held against all pairs."""
    if len(data) <= SLICE_BYTES:
        return np.unique(_codes(data), return_counts=True)
    seen = _pairs(data)
    at = np.flatnonzero(seen)
    return at, seen[at]


def _codes(data: bytes) -> np.ndarray:
    """A number for each pair of neighbouring bytes."""
    x = np.frombuffer(data, np.uint8)
    code = (x[:-1].astype(np.int64) << 8) | x[1:]
    code[1::2] |= 1 << 16
    return code


class Likelihoods:
    """A detector for ``readers.detect_encoding``: the encoding of the likeliest pairs, of those that the data decodes in if there
    are any; of equals the first.  Data of fewer than two bytes has none."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.tables = {name: np.log((n + 0.5) / (n.sum() + 0.5 * PAIRS)).astype(np.float32) for name, n in counts.items()}

    def __call__(self, data: bytes) -> str | None:
        if len(data) < 2 or not self.tables:
            return None
        at, seen = _seen(data)
        score = {name: float(seen @ t[at]) for name, t in self.tables.items()}
        sound = [name for name in score if self._decodes(data, name)]
        return max(sound or score, key=score.__getitem__)

    @staticmethod
    def _decodes(data: bytes, name: str) -> bool:
        try:
            data.decode(name)
        except UnicodeDecodeError:
            return False
        return True


def learn(texts: DataFrame, text: str = "text", encodings: Sequence[str] = ENCODINGS) -> Likelihoods:
    """Tables from all texts; characters that an encoding lacks are left out there.  No texts give tables that know nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = {name: np.zeros(PAIRS, np.int64) for name in encodings}, {name: [] for name in encodings}, 0

        def tally() -> None:
            for name, codes in held.items():
                if codes:
                    seen[name] += np.bincount(np.concatenate(codes), minlength=PAIRS)
                codes.clear()

        for batch in batches:
            for t in batch[0]:
                t = t.as_py() or ""
                for a in range(0, len(t), SLICE_BYTES):
                    part = t[a : a + SLICE_BYTES]
                    for name in encodings:
                        held[name].append(_codes(part.encode(name, "ignore")))
                    size += len(part)
                    if size >= SLICE_BYTES:  # short texts are counted together
                        tally()
                        size = 0
        tally()
        for name, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["name", "at", "n"])

    rows = texts.select(text).mapInArrow(count, "name string, at long, n long").groupBy("name", "at").agg(F.sum("n").alias("n")).toArrow()
    counts = {name: np.zeros(PAIRS, np.int64) for name in encodings}
    names, at, n = (np.array(rows["name"].to_pylist(), object), *(np.asarray(rows[c]) for c in ("at", "n")))
    for name, table in counts.items():
        table[at[names == name]] = n[names == name]
    return Likelihoods(counts)
