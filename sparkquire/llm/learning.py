"""Bounded training samples and small models, fitted on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import give_back
from ..storage import cut, modest_batches


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int, seed: str, columns: list[str] | None = None) -> DataFrame:
    """(doc_id, label columns, text) of about ``bound`` documents at most, checkpointed: ``labels``
    thinned by a hash of the id, one row an id.  Null ids and null labels are dropped; of repeated
    labels of an id the maximum counts, and of repeated documents the least text.
    docs: doc_id, text; labels: doc_id and ``columns``."""
    columns = columns or ["label"]
    some = " and ".join(["doc_id is not null", *(f"`{c}` is not null" for c in columns)])
    labels = labels.where(some).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in columns))
    n = labels.count()
    if n > bound:
        labels = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    # about ``bound`` rows of a few numbers, so the broadcast has a fixed size; an id that repeats is one row again
    rows = docs.join(F.broadcast(labels), "doc_id").groupBy("doc_id", *columns).agg(F.min("text").alias("text"))
    return cut(rows)


def over_texts(make: Callable[[], Callable[[pa.Array], pa.Array]], kind: str) -> Callable[[Column], Column]:
    """A function of a text column: ``make`` once a task, and what it makes on each Arrow batch.
    Only the text goes to Python and only results come back, whatever else the rows hold."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for column in texts:
            yield work(column)
        del work
        give_back()

    modest_batches(SparkSession.active())
    return F.arrow_udf(run, kind)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights with the intercept last, by accelerated gradient steps; classes weigh the same.
    With one class only the weights are 0 and the intercept is that class's smoothed log-odds."""
    n, w = len(y), np.zeros(x.shape[1] + 1)
    pos = float(y.sum())
    if pos in (0, n):
        w[-1] = np.log((pos + 1) / (n - pos + 1))
        return w
    each = np.where(y > 0, 0.5 / pos, 0.5 / (n - pos)).astype(np.float32)
    x, y = np.concatenate([x, np.ones((n, 1))], axis=1, dtype=np.float32), y.astype(np.float32)  # one type: no copy a step
    rate, shrink = np.float32(1 / (0.25 * float((each @ (x * x)).sum()) + l2)), np.full(len(w), l2, np.float32)
    shrink[-1] = 0
    w = v = w.astype(np.float32)
    for t in range(1, steps + 1):
        step = v - rate * ((each * (sigmoid(x @ v) - y)) @ x + shrink * v)
        v = step + np.float32((t - 1) / (t + 2)) * (step - w)
        w = step
    return w
