"""Quality of whole texts: histogram gradient-boosted trees over document statistics.

Statistics come from byte classes, word spans and line spans of a batch at once.  The trees
are complete and flattened into arrays (feature, threshold, leaf value), so that a batch
goes down all trees together, one gather a level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import IS_LINE_END, Piece, SpanHashes, give_back, mix, pieces, word_spans
from .learning import held_out, labelled_sample, over_texts, sigmoid

SAMPLE_ROWS = 15_000
TREES, DEPTH, BINS, RATE, L2, LEAST_WEIGHT = 60, 4, 48, 0.2, 1.0, 2.0

#: Byte classes: lower, upper, digit, blank, line end, sentence mark, exclamation, symbol, non-ASCII, control.
CLASSES = 10
BYTE_CLASS = np.full(256, 9, np.int64)
BYTE_CLASS[33:127] = 7
BYTE_CLASS[97:123], BYTE_CLASS[65:91], BYTE_CLASS[48:58], BYTE_CLASS[128:] = 0, 1, 2, 8
BYTE_CLASS[[32, 9]], BYTE_CLASS[[10, 13, 11, 12]], BYTE_CLASS[[ord("!")]] = 3, 4, 6
BYTE_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
NAMES = [f"share_{x}" for x in ("lower", "upper", "digit", "blank", "line_end", "mark", "exclamation", "symbol", "other", "control")] + ["log_bytes", "log_words", "word_length", "word_spread", "word_repeats_last", "distinct_words", "word_ends_in_symbol", "word_starts_upper", "log_line_length", "repeated_lines"]


def _distinct(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each different (row, h) is met first."""
    return np.unique(mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]


#: What a piece adds to its texts: byte classes, then these.
SUMS = CLASSES + 10
BYTES, WORDS, LENGTH, SQUARES, AGAIN, DIFFERENT, SYMBOL_ENDS, UPPER_STARTS, LINES, DIFFERENT_LINES = range(CLASSES, SUMS)


def _sums(p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows x SUMS, and the hashes of the words and lines."""
    n, size, kind = p.rows, np.diff(p.offsets), BYTE_CLASS[p.body]
    out, hashes = np.zeros((n, SUMS)), SpanHashes(p.body)
    out[:, :CLASSES] = np.bincount(np.repeat(np.arange(n) * CLASSES, size) + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    out[:, BYTES] = size
    starts, ends, out[:, WORDS] = word_spans(p.body, p.offsets)
    row, length, words = np.repeat(np.arange(n), out[:, WORDS].astype(int)), (ends - starts).astype(float), hashes(starts, ends)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    weights = {LENGTH: length, SQUARES: length**2, AGAIN: again, SYMBOL_ENDS: kind[ends - 1] >= 6, UPPER_STARTS: kind[starts] == 1}
    for c, w in weights.items():
        out[:, c] = np.bincount(row, w, n)
    out[:, DIFFERENT] = np.bincount(row[_distinct(row, words)], minlength=n)
    starts, ends, out[:, LINES] = word_spans(p.body, p.offsets, IS_LINE_END)
    row, lines = np.repeat(np.arange(n), out[:, LINES].astype(int)), hashes(starts, ends)
    out[:, DIFFERENT_LINES] = np.bincount(row[_distinct(row, lines)], minlength=n)
    return out, words, lines


def statistics(column: pa.Array) -> np.ndarray:
    """One row of NAMES a text; a null text is empty, and an empty text is all zeros.  A text that
    comes in pieces has the same numbers as in one, but that a line longer than a piece
    counts as several."""
    sums = np.zeros((len(column), SUMS))
    last, seen = None, ([], [])
    for p in pieces(column):
        own, words, lines = _sums(p)
        if p.part or p.more:  # of a long text: what a sum of pieces would count twice or miss
            own[0, AGAIN] += p.part > 0 and len(words) > 0 and last == words[0]
            last = words[-1] if len(words) else last
            for held, h in zip(seen, (words, lines)):
                held.append(np.unique(h))
            own[0, [DIFFERENT, DIFFERENT_LINES]] = 0 if p.more else [len(np.unique(np.concatenate(x))) for x in seen]
            if not p.more:
                last, seen = None, ([], [])
        sums[p.first : p.first + p.rows] += own
    out, size, words, lines = np.zeros((len(column), len(NAMES))), sums[:, BYTES], sums[:, WORDS], sums[:, LINES]
    some, rows = np.maximum(words, 1), np.maximum(lines, 1)
    mean = sums[:, LENGTH] / some
    out[:, :CLASSES] = sums[:, :CLASSES] / np.maximum(size, 1)[:, None]
    out[:, 10:13] = np.stack([np.log1p(size), np.log1p(words), mean], axis=1)
    out[:, 13] = np.sqrt(np.maximum(0, sums[:, SQUARES] / some - mean**2))
    out[:, 14:18] = sums[:, [AGAIN, DIFFERENT, SYMBOL_ENDS, UPPER_STARTS]] / some[:, None]
    out[:, 18] = np.log1p(size / rows)
    out[:, 19] = np.where(lines > 0, 1 - sums[:, DIFFERENT_LINES] / rows, 0)
    return out


@dataclass
class Trees:
    """feature and threshold: trees x inner nodes, breadth first; leaf: trees x leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(self.leaf):
            return sigmoid(out)
        trees = np.arange(len(self.leaf))[None, :]
        depth = int(np.log2(self.leaf.shape[1]))
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            rows, node = np.arange(len(part))[:, None], np.zeros((len(part), len(self.leaf)), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
            out[a : a + 4096] += self.leaf[trees, node - (2**depth - 1)].sum(axis=1)
        return sigmoid(out)


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Second-order boosting of the logistic loss on histograms of quantile bins.  Without
    both classes there are no trees, only the smoothed log-odds."""
    n, pos = len(y), float(np.sum(y))
    base = float(np.log((pos + 1) / (n - pos + 1)))
    inner, leaves, columns = 2**depth - 1, 2**depth, x.shape[1]
    if pos in (0, n):
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(columns)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(columns) * bins
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    total = np.full(n, base)
    for t in range(trees):
        p = sigmoid(total)
        g, h, node = p - y, np.maximum(p * (1 - p), 1e-6), np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            key = ((node - first)[:, None] * columns * bins + flat).ravel()
            gs, hs = (np.bincount(key, np.repeat(v, columns), wide * columns * bins).reshape(wide, columns, bins).cumsum(axis=2) for v in (g, h))
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + L2) + (ga - gs) ** 2 / (ha - hs + L2) - ga**2 / (ha + L2)
            gain[(hs < LEAST_WEIGHT) | (ha - hs < LEAST_WEIGHT)] = 0
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = 0  # there is nothing above the last edge
            best = gain.reshape(wide, -1).argmax(axis=1)
            for k in range(wide):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9:
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + L2)
        total += leaf[t][at]
    return Trees(base, feature, threshold, leaf)


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch["text"])
        yield pa.RecordBatch.from_arrays([batch["label"].cast(pa.float64()), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])
    give_back()


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Trees:
    """docs: doc_id, text; labels: doc_id, label in 0 and 1."""
    rows = labelled_sample(docs, labels, bound, "quality").select("label", "text").mapInArrow(_training_rows, "label double, x array<double>").toPandas()
    x = np.array(rows["x"].tolist()).reshape(len(rows), len(NAMES))
    y = rows["label"].to_numpy(float)
    order = np.lexsort((y, *x.T))  # the same trees whatever the order of the rows
    return fit_trees(x[order], y[order])


def quality_scorer(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Callable[[Column], Column]:
    """Fits on ``docs`` and ``labels`` and returns a function from a text column to its scores (0 to 1,
    higher: label 1 likelier).

    Labels of held-out ids (crc32 of the id as text, modulo ``folds``, is ``fold``) are never learnt
    from; the score is of the whole text alone.  Null and empty texts have zero statistics and
    a score all the same; without labels every score is 0.5.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where(~held_out(F.col("doc_id"), folds, fold))
    model = docs.sparkSession.sparkContext.broadcast(fit(plain, known))
    return over_texts(lambda: lambda column: pa.array(model.value.score(statistics(column))), "double")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, fold: int = 0, doc_id: str = "doc_id", text: str = "text", label: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default; those named like a result are dropped) and
    held_out, score (see ``quality_scorer``) and predicted (1: the score reaches the threshold).
    Every row gives a row, repeated ones too; a null id is not held out."""
    score = quality_scorer(docs, labels, folds, fold, doc_id, text, label)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("held_out", "score", "predicted")]
    rows = docs.select(*kept, held_out(F.col(doc_id), folds, fold).alias("held_out"), score(F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
