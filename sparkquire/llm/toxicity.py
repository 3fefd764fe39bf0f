"""Toxicity by a classifier chain over whole texts.

Categories are predicted in a fixed order by linear models on counts of telling words and word
beginnings; each later model also sees the earlier categories' probabilities.  In training
those are out-of-fold: what a model is shown of an earlier one for a row comes from a fit that
saw neither the row nor any row of an equal text, and whose features were chosen, and kinds
found, without them too.

Where the labels hold several categories, they are the chain.  Where they hold one alone, it is
the last link, and before it come ``kind_1`` .. ``kind_n``: clusters of its positive texts by the
telling words that they share.  Such kinds are weak categories: they imply the label, have
no names, and are there because positive texts of different vocabulary are better told
by models of their own than by one average.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import SpanHashes, give_back, pieces, word_spans
from .learning import fit_logistic, held_out, labelled_sample, over_texts, sigmoid
from ..storage import cut

SAMPLE_ROWS = 12_000
FEATURES = 512
FOLDS = 4
KINDS = 2
#: Features must be this much likelier, or less likely (as a logarithm), in positive texts: about three times.
LEAST_LIFT = 1.1
#: A feature has to be in so many texts of either side.
LEAST_TEXTS = 3
#: Bytes of a word's beginning that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7)
#: Words are runs of ASCII letters and non-ASCII bytes.
BETWEEN = np.ones(256, bool)
BETWEEN[65:91] = BETWEEN[97:123] = BETWEEN[128:] = False
#: Texts whose features are held at once.
TEXTS_AT_ONCE = 2000


def _features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature, feature): whole words, then beginnings of longer ones.
    A long text comes in several parts, one after another."""
    for p in pieces(column, BETWEEN):
        starts, ends, words = word_spans(p.body, p.offsets, BETWEEN)
        row, hashes = np.repeat(np.arange(p.rows), words), SpanHashes(p.body)
        rows, found = [row], [hashes(starts, ends)]
        for k in BEGINNINGS:
            long = ends - starts > k
            rows.append(row[long])
            found.append(hashes(starts[long], starts[long] + k) + np.uint64(k))
        yield p.first, p.rows, np.concatenate(rows), np.concatenate(found)


class Vocabulary:
    """The chosen features, looked up through a bitmap of their low 16 bits."""

    def __init__(self, features: np.ndarray):
        self.features = np.sort(features.astype(np.uint64))
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.features & np.uint64(0xFFFF)).astype(np.int64)] = True

    def counts(self, column: pa.Array) -> np.ndarray:
        """How often each feature stands in each text."""
        out, n = np.zeros((len(column), len(self.features)), np.float32), len(self.features)
        for first, rows, row, h in _features(column):
            near = self.seen[(h & np.uint64(0xFFFF)).astype(np.int64)]
            row, h = row[near], h[near]
            at = np.searchsorted(self.features, h)
            hit = at < n
            hit[hit] = self.features[at[hit]] == h[hit]
            out[first : first + rows] += np.bincount(row[hit] * n + at[hit], minlength=rows * n).reshape(rows, n)
        return out

    def strengths(self, column: pa.Array) -> np.ndarray:
        """What the chain is fitted on and scores: logarithms of 1 + counts in sixteenths, a byte each (8 million of one word fill it)."""
        return np.minimum(np.rint(16 * np.log1p(self.counts(column))), 255).astype(np.uint8)


@dataclass
class Chain:
    vocabulary: Vocabulary
    weights: list[np.ndarray]  # of each category: features, earlier probabilities, intercept

    def probabilities(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), len(self.weights)))
        for a in range(0, len(column), TEXTS_AT_ONCE):
            x = self.vocabulary.strengths(column.slice(a, TEXTS_AT_ONCE)) / np.float32(16)
            for k, w in enumerate(self.weights):
                out[a : a + TEXTS_AT_ONCE, k] = sigmoid(x @ w[: x.shape[1]] + out[a : a + TEXTS_AT_ONCE, :k] @ w[x.shape[1] : -1] + w[-1])
        return out


def _count_rows(folds: int):
    """How many positive and other texts of each fold hold each feature, summed over a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch["fold"].to_numpy() + folds * (batch["label"].to_numpy(zero_copy_only=False) <= 0)
            of_row: dict[int, list[np.ndarray]] = {}  # the parts of long texts
            keys, groups = [], []
            for first, rows, row, h in _features(batch["text"]):
                if rows == 1:
                    of_row.setdefault(first, []).append(np.unique(h))
                    continue
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                keys.append(h[new])
                groups.append(group[row[new] + first])
            for r, parts in of_row.items():
                keys.append(np.unique(np.concatenate(parts)))
                groups.append(np.full(len(keys[-1]), group[r]))
            if keys:
                u, at = np.unique(np.concatenate(keys), return_inverse=True)
                n = np.bincount(at * 2 * folds + np.concatenate(groups), minlength=len(u) * 2 * folds).reshape(len(u), 2 * folds)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *(pa.array(c) for c in n.T.astype(np.int64))], ["h", *(f"n{i}" for i in range(2 * folds))])
        give_back()

    return run


def _choose(sample: DataFrame, folds: int, features: int) -> list[np.ndarray]:
    """The features of all rows, then those chosen without each fold."""
    names = [f"n{i}" for i in range(2 * folds)]
    totals = sample.groupBy("fold").agg(F.sum((F.col("label") > 0).cast("long")).alias("bad"), F.sum((F.col("label") <= 0).cast("long")).alias("good")).collect()
    bad, good = np.zeros(folds), np.zeros(folds)
    for r in totals:
        bad[r.fold], good[r.fold] = r.bad, r.good
    counted = sample.select("fold", "label", "text").mapInArrow(_count_rows(folds), "h long, " + ", ".join(f"{c} long" for c in names))
    counted = counted.groupBy("h").agg(*(F.sum(c).alias(c) for c in names))
    enough = [sum((F.col(c) for c in half), F.lit(0)) >= LEAST_TEXTS for half in (names[:folds], names[folds:])]
    counted = cut(counted.where(enough[0] | enough[1]))
    out = []
    for without in (None, *range(folds)):
        inside = [f for f in range(folds) if f != without]
        t, o = (sum((F.col(names[f + shift]) for f in inside), F.lit(0)) for shift in (0, folds))
        # the log-ratio of a feature's shares of positive and other texts, two standard errors towards zero
        ratio = F.ln((t + 0.5) / F.lit(bad[inside].sum() + 1.0)) - F.ln((o + 0.5) / F.lit(good[inside].sum() + 1.0))
        lift = F.abs(ratio) - 2 * F.sqrt(1 / (t + 0.5) + 1 / (o + 0.5))
        best = counted.where((t >= LEAST_TEXTS) | (o >= LEAST_TEXTS)).select("h", lift.alias("lift")).where(F.col("lift") > LEAST_LIFT)
        out.append(np.array([r.h for r in best.orderBy(F.desc("lift"), "h").limit(features).collect()], np.int64).view(np.uint64))
    return out


def _training_rows(vocabulary: Vocabulary, categories: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), TEXTS_AT_ONCE):
                part = batch.slice(a, TEXTS_AT_ONCE)
                x = vocabulary.strengths(part["text"])
                y = np.stack([part[c].to_numpy(zero_copy_only=False) > 0 for c in categories], axis=1).astype(np.int8)
                yield pa.RecordBatch.from_arrays([part["fold"], pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in y], pa.binary())], ["fold", "x", "y"])
        give_back()

    return run


def kinds_of(x: np.ndarray, positive: np.ndarray, kinds: int, like: np.ndarray | None = None, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Clusters of the positive rows by the direction of x: (rows x kinds of 0 and 1, centres).  Centres
    begin far apart, and are numbered as those of ``like`` that they are nearest to.  With fewer
    than ten positive rows a kind there are none."""
    y, centres = np.zeros((len(x), kinds), np.int8), np.zeros((kinds, x.shape[1]), np.float32)
    rows = np.flatnonzero(positive & x.any(axis=1))
    if not kinds or len(rows) < 10 * kinds:
        return y, centres
    u = x[rows] / np.linalg.norm(x[rows], axis=1, keepdims=True)
    centres[0] = u.mean(axis=0)
    nearest = u @ centres[0]
    for k in range(kinds):  # the first is the one farthest from the mean
        centres[k] = u[int(nearest.argmin())]
        nearest = u @ centres[k] if k == 0 else np.maximum(nearest, u @ centres[k])
    for _ in range(rounds):
        of = (u @ centres.T).argmax(axis=1)
        new = np.stack([u[of == k].sum(axis=0) if (of == k).any() else centres[k] for k in range(kinds)])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centres):
            break
        centres = new.astype(np.float32)
    if like is not None:
        near, order = centres @ like.T, np.full(kinds, -1)
        for _ in range(kinds):
            a, b = np.unravel_index(int(near.argmax()), near.shape)
            order[b], near[a, :], near[:, b] = a, -np.inf, -np.inf
        centres = centres[order]
    y[rows, (u @ centres.T).argmax(axis=1)] = 1
    return y, centres


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, used: Sequence[np.ndarray] | None = None, kinds: int = 0) -> list[np.ndarray]:
    """One weight vector for each kind and then each column of y: features, earlier probabilities, intercept.

    used: columns of x for the final fits, then for those without each fold (all by default).
    """
    folds = int(fold.max()) + 1 if len(fold) else 0
    used = used or [np.arange(x.shape[1])] * (folds + 1)
    every, centres = kinds_of(x, y[:, -1] > 0, kinds)
    targets = np.concatenate([every, y], axis=1)
    within = []  # the targets as those rows see them that aren't in the fold
    for f in range(folds):
        mine = np.zeros((len(x), x.shape[1]), np.float32)
        mine[:, used[f + 1]] = x[:, used[f + 1]]
        within.append(np.concatenate([kinds_of(mine, (y[:, -1] > 0) & (fold != f), kinds, centres)[0], y], axis=1) if kinds else y)
    weights, shown = [], np.zeros((len(x), 0), np.float32)
    for k in range(targets.shape[1]):
        weights.append(fit_logistic(np.concatenate([x[:, used[0]], shown], axis=1), targets[:, k].astype(float)))
        if k + 1 < targets.shape[1]:
            out = np.zeros(len(x), np.float32)
            for f in range(folds):
                rest, mine = fold != f, fold == f
                both = np.concatenate([x[:, used[f + 1]], shown], axis=1)
                w = fit_logistic(both[rest], within[f][rest, k].astype(float), steps=120)
                out[mine] = sigmoid(both[mine] @ w[:-1] + w[-1])
            shown = np.concatenate([shown, out[:, None]], axis=1)
    return weights


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("toxic",), kinds: int = KINDS, bound: int = SAMPLE_ROWS, features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """docs: doc_id, text; labels: doc_id and the categories in 0 and 1, the last one the score's."""
    columns = [f"c{i}" for i in range(len(categories))]
    labels = labels.select("doc_id", *(F.col(c).alias(n) for c, n in zip(categories, columns)))
    sample = labelled_sample(docs, labels, bound, "toxicity", columns)
    # equal texts are in one fold
    sample = sample.select(*columns, F.col(columns[-1]).alias("label"), "text", F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(folds)).cast("int").alias("fold"))
    chosen = _choose(sample, folds, features)
    vocabulary = Vocabulary(np.unique(np.concatenate(chosen)))
    rows = sample.mapInArrow(_training_rows(vocabulary, columns), "fold int, x binary, y binary").toPandas()
    rows = rows.sort_values(["y", "x", "fold"], kind="stable")  # the same sums whatever the order of the rows
    x = np.frombuffer(b"".join(rows["x"]), np.uint8).reshape(len(rows), len(vocabulary.features)) / np.float32(16)
    y, fold = np.frombuffer(b"".join(rows["y"]), np.int8).reshape(len(rows), len(columns)), rows["fold"].to_numpy(copy=True)
    del rows  # the driver holds the sample once
    used = [np.searchsorted(vocabulary.features, np.sort(c)) for c in chosen]
    weights = fit_chain(x, y, fold, used, kinds if len(columns) == 1 else 0)
    return Chain(Vocabulary(chosen[0]), weights)


def toxicity_scorer(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("toxic",), kinds: int = KINDS, folds: int = 5, fold: int = 0, doc_id: str = "doc_id", text: str = "text") -> tuple[Callable[[Column], Column], list[str]]:
    """Fits on ``docs`` and ``labels``; a function from a text column to a struct, and the struct's
    fields: p_<category> of every link but the last, then score, the probability of the last.

    Labels of held-out ids (crc32 of the id as text, modulo ``folds``, is ``fold``) are never learnt
    from.  Null and empty texts have no features and the score of the intercepts; without
    labels every score is 0.5.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = labels.select(F.col(doc_id).alias("doc_id"), *categories).where(~held_out(F.col("doc_id"), folds, fold))
    names = [f"p_kind_{k + 1}" for k in range(kinds)] if len(categories) == 1 else [f"p_{c}" for c in categories[:-1]]
    names.append("score")
    model = docs.sparkSession.sparkContext.broadcast(fit(plain, known, categories, kinds))

    def score(column: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(p) for p in model.value.probabilities(column).T.copy()], names)

    return over_texts(lambda: score, f"struct<{', '.join(f'{c}: double' for c in names)}>"), names


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, categories: Sequence[str] = ("toxic",), kinds: int = KINDS, folds: int = 5, fold: int = 0, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default; those named like a result are dropped) and held_out,
    the probabilities and score (see ``toxicity_scorer``) and predicted (1: the score is above the
    threshold).  Every row gives a row, repeated ones too; null ids are not held out."""
    score, names = toxicity_scorer(docs, labels, categories, kinds, folds, fold, doc_id, text)
    results = ["held_out", *names, "predicted"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in results]
    rows = docs.select(*kept, held_out(F.col(doc_id), folds, fold).alias("held_out"), score(F.col(text)).alias(" p"))
    rows = rows.select(*kept, "held_out", *(F.col("` p`")[c].alias(c) for c in names))
    return rows.withColumn("predicted", (F.col("score") > threshold).cast("int"))
