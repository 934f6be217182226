"""Hard negatives of anchors, by a secondary-sort shuffle of scored pairs.

Components are floored multiples of a scale, and a row's score is its integer inner product with the anchor. Rows are
written once to the shared folder, in lanes of bounded size, and so are the anchors, in chunks; tasks multiply a chunk
with lanes, so no vector is shuffled for an anchor. Of each chunk and lane, only pairs that can matter leave a task: first
each anchor's best rows of its own label, then, when the scores of its positives are known, the first negatives in the
window of each positive. What leaves is packed into keys (anchor, descending score, side, id), which
repartitionAndSortWithinPartitions deals by anchor and sorts. An iterator goes through a partition once: a row of the
anchor's label opens a window, another row is a negative of each open window that holds its score and isn't full. It
keeps the windows of one anchor, never its rows. At equal scores positives come before negatives, so that a window of
score 0 is open when its negatives pass.

Rows with a null id, label or vector, or with a null or non-finite component, take no part, nor do rows of another length
than that of the least id. Rows with an anchor's id are no candidates for it; of several rows of an anchor's id, the one
with the least (label, vector) is the anchor. Repeated rows are separate candidates, ties go to the smaller id. A
component that a long can't hold is the nearest long, and sums that it can't hold wrap around. A positive with a negative
score has no window. An empty table, or one without anchors, gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import mapped, shared_dir, store_arrays
from lamina.llm.neighbours import parts_of, stored_parts

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Percent of a positive's score that its negatives have at least and at most.
WINDOW = (30, 90)
#: The least and largest number of rows in a lane and of anchors in a chunk, and of bytes of their vectors at most.
LANE, CHUNK, PART_BYTES = (4096, 262_144), (256, 16_384), 64 << 20
#: Rows of a lane that are multiplied at once, and anchors.
BLOCK, GROUP = 8192, 64
PAIR = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    if anchors.size and rows.size and anchors.shape[1] * float(np.abs(anchors.astype(float)).max()) * float(np.abs(rows.astype(float)).max()) < 2.0**52:
        return (anchors.astype(float) @ rows.astype(float).T).astype(np.int64)
    return anchors.astype(np.int64) @ rows.astype(np.int64).T


def first_of(score: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
    """Places of the n rows that come first: higher scores, then smaller ids."""
    return np.lexsort((who, -score))[:n]


class Best:
    """The n rows that come first among those shown so far."""

    def __init__(self, n: int):
        self.n, self.score, self.who = n, np.empty(0, np.int64), np.empty(0, np.int64)
        self.least: int | None = None  # a row with a lower score doesn't come in

    def take(self, score: np.ndarray, who: np.ndarray) -> None:
        score, who = np.concatenate([self.score, score]), np.concatenate([self.who, who])
        on = first_of(score, who, self.n)
        self.score, self.who = score[on], who[on]
        if len(on) == self.n:
            self.least = int(self.score[-1])


def scored(own: np.ndarray, anchors: np.ndarray, lanes: Iterable[list[np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor's place, and scores, labels and ids of a block of rows without the anchor's own id, for each anchor and block."""
    for who, label, vectors in lanes:
        for at in range(0, len(who), BLOCK):
            who_, label_, vectors_ = (np.asarray(x[at : at + BLOCK]) for x in (who, label, vectors))
            for first in range(0, len(own), GROUP):
                score = products(anchors[first : first + GROUP], vectors_)
                for i in range(len(score)):
                    other = who_ != own[first + i]
                    yield first + i, score[i][other], label_[other], who_[other]


def best_of_label(own: np.ndarray, label: np.ndarray, anchors: np.ndarray, lanes: Iterable[list[np.ndarray]], n: int) -> list[Best]:
    """Each anchor's first n rows of its label in the lanes."""
    found = [Best(n) for _ in own]
    for i, score, labels, who in scored(own, anchors, lanes):
        on = labels == label[i]
        if found[i].least is not None:
            on &= score >= found[i].least
        if on.any():
            found[i].take(score[on], who[on])
    return found


def bounds(positive: int, window: tuple[int, int]) -> tuple[int, int]:
    """The least and largest score of a positive's negatives."""
    return -(-window[0] * positive // 100), window[1] * positive // 100


def best_in_windows(own: np.ndarray, label: np.ndarray, anchors: np.ndarray, lanes: Iterable[list[np.ndarray]], positives: list[list[int]], window: tuple[int, int], n: int) -> list[list[tuple[int, int]]]:
    """(score, id) of the rows of other labels in the lanes that are among the first n in a window of one of the anchor's positives, each row once. positives: the scores of each anchor's."""
    windows = [[(*bounds(p, window), Best(n)) for p in set(of)] for of in positives]
    for i, score, labels, who in scored(own, anchors, lanes):
        other = labels != label[i]
        for low, high, best in windows[i]:
            least = low if best.least is None else max(low, best.least)
            on = other & (score >= least) & (score <= high)
            if on.any():
                best.take(score[on], who[on])
    out = []
    for of in windows:
        held = [Counter(zip(best.score.tolist(), best.who.tolist(), strict=True)) for _, _, best in of]
        out.append(list(reduce(or_, held, Counter()).elements()))  # repeated rows: as many as the window with most of them has
    return out


def mined(keys: Iterator[tuple[tuple[int, int, int, int], None]], window: tuple[int, int], positives: int, negatives: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Rows of PAIR from sorted keys (anchor, -score, side, id); side: 0 for the anchor's label. Keeps the windows of one anchor."""
    low, high = window
    anchor, opened = None, []
    for (of, minus, side, who), _ in keys:
        if of != anchor:
            anchor, opened = of, []
        if not side:
            if len(opened) < positives:
                opened.append([who, -minus, 0])
            continue
        for w in opened:
            if w[2] < negatives and low * w[1] <= -100 * minus <= high * w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], who, w[1], -minus


def hard_negatives(rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, lane: tuple[int, int] = LANE, chunk: tuple[int, int] = CHUNK) -> DataFrame:
    """Rows of PAIR: for each anchor and positive, its first negatives, ranked from 1.

    is_anchor, label: of the columns of rows. lane, chunk: the least and largest number of rows and anchors in one.
    """
    spark = rows.sparkSession
    doubles = F.col(vector).cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = (F.col(label) if isinstance(label, str) else label).cast("long")
    used = rows.where(F.coalesce(finite & label.isNotNull() & F.col(key).isNotNull(), F.lit(False)))
    # The label goes before the components.
    whole = F.concat(F.array(label), F.transform(doubles, lambda x: F.floor(x * scale)))
    used = used.select(F.col(key).cast("long").alias("id"), whole.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    most = F.greatest(F.array_max("vector"), -(F.array_min("vector") + 1))
    known = used.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.min(F.struct("id", F.size("vector").alias("width"))).alias("first"), F.max(most).alias("most")).first()
    width = known["first"]["width"] if known["n"] else 1
    kind = next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if (known["most"] or 0) < 1 << bits)
    used = used.where(F.size("vector") == width)
    held = PART_BYTES // (width * int(kind[-1]))
    lanes, chunks = (parts_of(n, (size[0], max(size[0], min(size[1], held))), least) for n, size, least in ((known["n"], lane, 8), (known["q"], chunk, 4)))
    folder = shared_dir(spark)
    kinds = ("<i8", "<i8", f"({width - 1},){kind}")

    def stored(name: str) -> Callable[[int, np.ndarray, np.ndarray], None]:
        def store(number: int, ids: np.ndarray, vectors: np.ndarray) -> None:
            vectors = vectors.reshape(len(ids), width).astype(np.int64)
            store_arrays(f"{folder}/{name}-{number}", [ids, vectors[:, 0].copy(), vectors[:, 1:].astype(kind)])

        return store

    asks = used.where("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    if not stored_parts(used.select("id", "vector"), lanes, stored("lane")) or not stored_parts(asks, chunks, stored("chunk")):
        return spark.createDataFrame([], PAIR)
    several = min(16, max(1, lanes * chunks // 256))  # lanes that a task goes through
    tasks = -(-lanes // several) * chunks

    def parts(task: int) -> tuple[list[np.ndarray], Iterator[list[np.ndarray]]]:
        first = task // chunks * several
        return mapped(f"{folder}/chunk-{task % chunks}", kinds), (mapped(f"{folder}/lane-{i}", kinds) for i in range(first, min(lanes, first + several)))

    def same_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column("id").to_pylist():
                (own, of, anchors), index = parts(task)
                found = best_of_label(own, of, np.asarray(anchors), index, positives)
                size = [len(x.who) for x in found]
                score, who = (np.concatenate([np.empty(0, np.int64), *(getattr(x, c) for x in found)]) for c in ("score", "who"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), task % chunks, np.int32)), pa.array(np.repeat(np.asarray(own), size)), pa.array(score), pa.array(who)], names=["chunk", "anchor", "score", "id"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate([np.empty(0, np.int64), *(np.asarray(b.column(c)) for b in held)]) for held in [list(batches)] for c in ("anchor", "score", "id")]
        store_arrays(f"{folder}/positives-{TaskContext.get().partitionId()}", columns)
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(columns[0])], pa.int64())})

    met = spark.range(0, tasks, 1, tasks).mapInArrow(same_label, "chunk int, anchor long, score long, id long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    first = met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives).drop("nth")
    if not first.repartitionById(chunks, F.col("chunk")).mapInArrow(kept, "n long").agg(F.sum("n")).first()[0]:
        return spark.createDataFrame([], PAIR)

    def pairs(numbers: Iterator[int]) -> Iterator[tuple[tuple[int, int, int, int], None]]:
        for task in numbers:
            (own, of, anchors), index = parts(task)
            asked, score, who = (x.tolist() for x in mapped(f"{folder}/positives-{task % chunks}", ("<i8", "<i8", "<i8")))
            by_anchor: dict[int, list[int]] = {}
            for a, s in zip(asked, score, strict=True):
                by_anchor.setdefault(a, []).append(s)
            if task < chunks:  # the first lanes' tasks bring the positives too
                yield from (((a, -s, 0, w), None) for a, s, w in zip(asked, score, who, strict=True))
            found = best_in_windows(own, of, np.asarray(anchors), index, [by_anchor.get(a, []) for a in own.tolist()], window, negatives)
            for a, rows in zip(own.tolist(), found, strict=True):
                yield from (((a, -s, 1, w), None) for s, w in rows)

    keys = spark.sparkContext.parallelize(range(tasks), tasks).mapPartitions(pairs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionAndSortWithinPartitions(n, lambda k: k[0] * 0x9E3779B97F4A7C15 >> 32)
    return spark.createDataFrame(dealt.mapPartitions(lambda x: mined(x, window, positives, negatives)), PAIR, verifySchema=False)
