"""Order-dependent folds: running sums that start anew, budget batches, windows, clusters.

Each is one pass over a sequence's light rows (an id and a number).  A sequence is a book, line
or document, whose length is bounded by what one is; the rows of different sequences spread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULTS


def _fold(rows: DataFrame, key: str, order: list[str], columns: list[str], schema: str, step: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = step(part.sort_values(order, kind="stable"))
        out.insert(0, key, part[key].iat[0])
        return out

    names = [key, *dict.fromkeys([*order, *columns])]
    return rows.select(*names).groupBy(key).applyInPandas(run, f"`{key}` {kind[key]}, {schema}")


def _stream(rows: DataFrame, key: str, order: str, column: str, names: list[str], begin: Callable[[], Callable[[np.ndarray], list[np.ndarray]]]) -> DataFrame:
    """key, order and numbers ``names``: the fold goes through a key's rows batch by batch, so that a task holds a batch of a
    sequence and never all of it.  ``begin`` gives what folds one sequence: a function that is called with stretch after stretch."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fold = None, None
        for part in batches:
            keys = part[key]
            new = np.flatnonzero(((keys != keys.shift()) & ~(keys.isna() & keys.shift().isna())).to_numpy()[1:]) + 1
            for i, j in zip([0, *new], [*new, len(part)]):
                if i == j:
                    continue
                k = None if pd.isna(keys.iat[i]) else keys.iat[i]
                if fold is None or k != at:
                    at, fold = k, begin()
                piece = part.iloc[i:j]
                yield pd.DataFrame({key: piece[key], order: piece[order], **dict(zip(names, fold(piece[column].to_numpy())))})

    light = rows.select(*dict.fromkeys((key, order, column)))
    dealt = light.repartition(key).sortWithinPartitions(F.col(key), F.col(order).asc_nulls_last())
    return dealt.mapInPandas(run, f"`{key}` {kind[key]}, `{order}` {kind[order]}, " + ", ".join(f"{n} long" for n in names))


def budget_batches(rows: DataFrame, key: str, order: str, cost: str, budget: int, most: int | None = None) -> DataFrame:
    """key, order, batch (from 0): consecutive rows whose costs stay within the budget, ``most`` to
    a batch; a row over the budget is a batch of its own."""

    def begin() -> Callable[[np.ndarray], list[np.ndarray]]:
        batch, total, n = -1, 0, 0

        def fold(costs: np.ndarray) -> list[np.ndarray]:
            nonlocal batch, total, n
            out = np.empty(len(costs), np.int64)
            for i, c in enumerate(costs.tolist()):
                if batch < 0 or total + c > budget or (most is not None and n >= most):
                    batch, total, n = batch + 1, 0, 0
                total, n = total + c, n + 1
                out[i] = batch
            return [out]

        return fold

    return _stream(rows, key, order, cost, ["batch"], begin)


def group_batches(rows: DataFrame, key: str, order: str, group: str, size: int) -> DataFrame:
    """Batches that never part a group's rows: a new one begins at a group's start once ``size`` is reached."""

    def begin() -> Callable[[np.ndarray], list[np.ndarray]]:
        batch, n, last = 0, 0, object()

        def fold(groups: np.ndarray) -> list[np.ndarray]:
            nonlocal batch, n, last
            out = np.empty(len(groups), np.int64)
            for i, g in enumerate(groups.tolist()):
                if n >= size and g != last:
                    batch, n = batch + 1, 0
                last, n = g, n + 1
                out[i] = batch
            return [out]

        return fold

    return _stream(rows, key, order, group, ["batch"], begin)


def chapter_starts(rows: DataFrame, key: str, order: str, chars: str, per_chapter: int = DEFAULTS.chapter_chars, per_volume: int = DEFAULTS.volume_chapters) -> DataFrame:
    """key, order, chapter, volume (from 0): a chapter begins where the rows before it, since the
    last start, reached ``per_chapter``.  Holes weigh 0."""

    def begin() -> Callable[[np.ndarray], list[np.ndarray]]:
        chapter, total = -1, 0

        def fold(sizes: np.ndarray) -> list[np.ndarray]:
            nonlocal chapter, total
            out = np.empty(len(sizes), np.int64)
            for i, c in enumerate(sizes.tolist()):
                if chapter < 0 or total >= per_chapter:
                    chapter, total = chapter + 1, 0
                total += c
                out[i] = chapter
            return [out, out // per_volume]

        return fold

    return _stream(rows.withColumn(chars, F.coalesce(chars, F.lit(0))), key, order, chars, ["chapter", "volume"], begin)


def overlapping_windows(sizes: list[int], budget: int, overlap: int = DEFAULTS.window_overlap) -> Iterator[tuple[int, int]]:
    """[start, end) of windows whose sizes (plus a line end each) stay within the budget; each
    goes on ``overlap`` rows before the last one's end, and forward by a row at least.

    The end of a window is known for every row that it may start at, from running totals; the windows are a path
    through these ends."""
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64) + 1)])
    fits = np.searchsorted(total, total[:n] + budget, side="right") - 1
    ends = np.clip(fits, np.arange(1, n + 1) + overlap, n)
    start = 0
    while start < n:
        end = int(ends[start])
        yield start, end
        start = end - overlap if end < n else n


def window_rows(rows: DataFrame, key: str, order: str, size: str, budget: int, overlap: int = DEFAULTS.window_overlap) -> DataFrame:
    """key, window, first, last (places from 0, last beyond the end)."""

    def step(p: pd.DataFrame) -> pd.DataFrame:
        found = list(overlapping_windows(p[size].tolist(), budget, overlap))
        return pd.DataFrame({"window": range(len(found)), "first": [a for a, _ in found], "last": [b for _, b in found]})

    return _fold(rows, key, [order], [size], "window long, first long, last long", step)


def gap_clusters(rows: DataFrame, key: str, position: str, distance: float = DEFAULTS.gap_cluster_distance) -> DataFrame:
    """key, position, cluster, centre: sorted positions join the cluster before them while they lie
    nearer than ``distance`` to its centre, halfway between its first and last position."""

    def step(p: pd.DataFrame) -> pd.DataFrame:
        ends: list[list[float]] = []
        of = []
        for x in p[position]:
            if ends and x - (ends[-1][0] + ends[-1][1]) / 2 < max(distance, 1e-9):
                ends[-1][1] = x
            else:
                ends.append([x, x])
            of.append(len(ends) - 1)
        return pd.DataFrame({"position": p[position].to_numpy(float), "cluster": of, "centre": [round(sum(ends[k]) / 2, 6) for k in of]})

    return _fold(rows, key, [position], [], "position double, cluster long, centre double", step)


def sample_stride(costs: list[int], budget: int) -> int:
    """The least stride, from the ratio of all costs to the budget upwards, whose rows fit."""
    if sum(costs) <= budget:
        return 1
    step = max(1, -(-sum(costs) // max(budget, 1)))
    while step < len(costs) and sum(costs[::step]) > budget:
        step += 1
    return step
