"""Whole groups of rows for work that no expression can express, many small groups at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def in_whole_groups(rows: DataFrame, keys: list[str], order: list[str], f: Callable[[pa.Table], pa.Table], schema: str, deal: int = 1) -> DataFrame:
    """f of tables that hold one or several whole groups, sorted by keys and order; keys are whole numbers, the first of which (or so many as deal says) deal the rows.

    A task sorts its rows on disk and holds a batch and the group at its end; small groups cost nothing of their own.
    """

    def key(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([np.asarray(batch.column(k)) for k in keys], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = key(batch)
            change = np.flatnonzero((k[1:] != k[:-1]).any(axis=1))
            cut = int(change[-1]) + 1 if len(change) else 0
            other = bool(held) and (key(held[-1].slice(held[-1].num_rows - 1))[0] != k[0]).any()
            if cut or other:
                if done := held + ([batch.slice(0, cut)] if cut else []):
                    yield from f(pa.Table.from_batches(done)).to_batches()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from f(pa.Table.from_batches(held)).to_batches()

    return rows.repartition(*keys[:deal]).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def touching_runs(group: np.ndarray, y: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs of neighbouring rows of one group that touch, diagonally too. Runs are sorted by group, y and start."""
    if not len(y):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (y[1:] != y[:-1])])
    row = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    follows = np.concatenate([(group[first[1:]] == group[first[:-1]]) & (y[first[1:]] == y[first[:-1]] + 1), [False]])
    left = start.min()
    wide = int(end.max()) - int(left) + 3
    i = np.flatnonzero(follows[row])
    below = (row[i] + 1) * wide - left
    low = np.searchsorted(row * wide + end - left, below + start[i] - 1, "left")
    high = np.searchsorted(row * wide + start - left, below + end[i] + 1, "right")
    count = np.maximum(0, high - low)
    return np.repeat(i, count), np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def least_connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is linked with."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        least = np.minimum(x, y)
        if (x == y).all():
            return label
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label != (up := label[label])).any():
            label = up


def merged_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans of places (ends inclusive) that cover the same places without touching."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1] + 1]))
    return start[first], end[np.append(first[1:], len(start)) - 1]


def grown_spans(places: np.ndarray, radius: int, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans of pixels grown by a square of the radius within their images. A place is (image * height + y) * (width + 2) + x, so that spans of two rows never touch."""
    wide = width + 2
    start, end = merged_spans(places, places)
    if not radius:
        return start, end
    row = start // wide
    start, end, y = np.maximum(0, start - row * wide - radius), np.minimum(width - 1, end - row * wide + radius), row % height
    kept = [(d, (y + d >= 0) & (y + d < height)) for d in range(-radius, radius + 1)]
    return merged_spans(np.concatenate([(row[k] + d) * wide + start[k] for d, k in kept]), np.concatenate([(row[k] + d) * wide + end[k] for d, k in kept]))
