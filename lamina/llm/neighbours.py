"""Approximate nearest neighbours by largest inner product, with randomly rotated one-bit codes.

A vector's direction is rotated at random; the signs are its code (packed bits), and its norm and the inner product of
direction and code are kept as correction scalars. A query's inner product with a vector is estimated from the code;
the estimate's error has a bound that follows from the scalars. Within each block of vectors, those whose upper bound
reaches the k-th largest lower bound met so far are reranked by exact inner products in double precision.

Every vector is indexed and meets every query, in blocks: the index is written once to the shared folder, in lanes of
bounded size, and so are the queries, in chunks. A task maps one chunk and, one after another, some lanes; it reads all
codes, and original vectors only of those to be reranked. Neither is shuffled for each other; what is shuffled are k
rows of each query and task.

Vectors that are null, zero or of another length than the first, or that hold null or non-finite components, and rows
with a null id take no part. A query's own id is no candidate for it. Ties go to the smaller id; repeated rows are
separate candidates; of several rows of a query's id, the least vector asks. An empty table or query set gives no rows.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import mapped, shared_dir, store_arrays

#: Standard errors that an estimate may be off.
BOUND = 2.5
#: The least and largest number of vectors in a lane and of queries in a chunk, and of lanes that a task goes through.
LANE, CHUNK, LANES = (4096, 524_288), (256, 65_536), (1, 16)
#: Bytes of vectors in a lane or chunk, at most (but for the least numbers above).
PART_BYTES = 128 << 20


@lru_cache(maxsize=2)
def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def usable(vectors: Column) -> Column:
    """Whether a vector takes part, as far as that is seen without its length."""
    v = vectors.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vectors.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def coded(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, norms, and inner products of each direction with its code."""
    dims = vectors.shape[1]
    norm = np.linalg.norm(vectors, axis=1)
    turned = (vectors / norm[:, None]) @ rotation(dims, seed)
    return np.packbits(turned > 0, axis=1), norm, np.abs(turned).sum(axis=1) / np.sqrt(dims)


def lane_kinds(dims: int, kind: str) -> tuple[str, ...]:
    """id, norm, fit, code and vector of a lane's file."""
    return ("<i8", "<f8", "<f8", f"({-(-dims // 8)},)u1", f"({dims},){kind}")


def stored_parts(rows: DataFrame, parts: int, store: Callable[[int, np.ndarray, np.ndarray], None]) -> int:
    """Deals rows (id, vector) to so many parts, equal ones too, and has each stored by its number, ids and vectors; empty ones too, unless all are. Returns the number of rows."""

    def salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield batch.append_column("salt", pa.array(range(at, at + batch.num_rows), pa.int64()))
            at += batch.num_rows

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        ids = np.concatenate([np.asarray(b.column("id")) for b in held]) if held else np.empty(0, np.int64)
        vectors = np.concatenate([b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in held]) if held else np.empty((0, 0))
        store(TaskContext.get().partitionId(), ids, vectors)
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(ids)], pa.int64())})

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    dealt = rows.mapInArrow(salted, f"{kinds}, salt long").repartitionById(parts, F.pmod(F.xxhash64("id", "salt"), F.lit(parts)).cast("int"))
    return dealt.select("id", "vector").mapInArrow(kept, "n long").agg(F.sum("n")).first()[0] or 0


def best(queries: np.ndarray, own: np.ndarray, lanes: Iterable[list[np.ndarray]], k: int, seed: int, bound: float, block: int = 4096, group: int = 128) -> list[tuple[np.ndarray, np.ndarray]]:
    """ids and scores of each query's k best vectors in the lanes (id, norm, fit, code, vector), which are gone through in turn."""
    dims = queries.shape[1]
    turned = (queries @ rotation(dims, seed)).astype(np.float32)
    size = np.linalg.norm(queries, axis=1)
    found_i = [np.empty(0, np.int64)] * len(own)
    found_s = [np.empty(0)] * len(own)
    least = np.full(len(own), -np.inf)  # k-th best exact score so far
    for ids, norm, fit, code, vectors in lanes:
        for b in range(0, len(ids), block):
            part = slice(b, b + block)
            who_, norm_, fit_ = (np.asarray(x[part]) for x in (ids, norm, fit))
            signs = np.unpackbits(code[part], axis=1, count=dims).astype(np.float32) * 2 - 1
            error = bound * norm_ * np.sqrt(np.maximum(0, 1 - fit_**2)) / (fit_ * np.sqrt(max(1, dims - 1))) + 1e-5 * norm_
            scale = norm_ / (fit_ * np.sqrt(dims))
            for at in range(0, len(own), group):
                q = slice(at, at + group)
                guess = (turned[q] @ signs.T) * scale
                slack = error[None, :] * size[q][:, None]
                same = who_[None, :] == own[q][:, None]
                low = np.where(same, -np.inf, guess - slack)
                n = min(k, low.shape[1])
                floor = np.partition(low, low.shape[1] - n, axis=1)[:, low.shape[1] - n] if n == k else np.full(len(low), -np.inf)
                keep = (guess + slack >= np.maximum(floor, least[q])[:, None]) & ~same
                for i in range(len(low)):
                    on = np.flatnonzero(keep[i])
                    if len(on):
                        score = np.concatenate([found_s[at + i], vectors[part][on].astype(np.float64) @ queries[at + i]])
                        who = np.concatenate([found_i[at + i], who_[on]])
                        order = np.lexsort((who, -score))[:k]
                        found_i[at + i], found_s[at + i] = who[order], score[order]
                        if len(order) == k:
                            least[at + i] = found_s[at + i][-1]
    return list(zip(found_i, found_s, strict=True))


def parts_of(n: int, size: tuple[int, int], least: int) -> int:
    """Parts of a size within bounds, so many at least where that size allows it."""
    return -(-n // min(size[1], max(size[0], -(-n // least)))) or 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", seed: int = 5, bound: float = BOUND, lane: tuple[int, int] = LANE, chunk: tuple[int, int] = CHUNK) -> DataFrame:
    """query_id, rank (from 1), key and score of the k vectors found nearest to each query.

    is_query: of the columns of vectors. lane, chunk: the least and largest number of vectors and queries in one.
    """
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)[vector] == "array<float>" else "<f8"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    known = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.min(F.struct("id", F.size("vector").alias("dims"))).alias("first")).first()
    dims = known["first"]["dims"] if known["n"] else 0
    rows = rows.where(F.size("vector") == dims)
    most = PART_BYTES // max(1, dims * int(kind[-1]))
    lanes, chunks = (parts_of(n, (size[0], max(size[0], min(size[1], most))), least) for n, size, least in ((known["n"], lane, 8), (known["q"], chunk, 4)))
    folder = shared_dir(spark)

    def store_lane(number: int, ids: np.ndarray, vectors: np.ndarray) -> None:
        blocks = [coded(vectors[at : at + 4096].astype(np.float64), seed) for at in range(0, len(ids), 4096)]
        code, norm, fit = (np.concatenate(x) for x in zip(*blocks, strict=True)) if blocks else (np.empty(0),) * 3
        store_arrays(f"{folder}/lane-{number}", [ids, norm, fit, code, vectors.astype(kind)])

    def store_chunk(number: int, ids: np.ndarray, vectors: np.ndarray) -> None:
        store_arrays(f"{folder}/chunk-{number}", [ids, vectors.astype(kind)])

    asks = rows.where("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    if not stored_parts(rows.select("id", "vector"), lanes, store_lane) or not stored_parts(asks, chunks, store_chunk):
        lanes = 0
    several = min(LANES[1], max(LANES[0], lanes * chunks // 256))
    groups = -(-lanes // several)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column("id").to_pylist():
                own, queries = mapped(f"{folder}/chunk-{task % chunks}", ("<i8", f"({dims},){kind}"))
                first = task // chunks * several
                index = (mapped(f"{folder}/lane-{i}", lane_kinds(dims, kind)) for i in range(first, min(lanes, first + several)))
                found = best(np.asarray(queries, np.float64), np.asarray(own), index, k, seed, bound) if len(own) else []
                for at in range(0, len(found), 4096):
                    some = found[at : at + 4096]
                    ids = np.repeat(own[at : at + 4096], [len(x) for x, _ in some])
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([x for x, _ in some])), pa.array(np.concatenate([x for _, x in some]))], names=["query_id", "id", "score"])

    tasks = spark.range(0, groups * chunks, 1, max(1, groups * chunks))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return tasks.mapInArrow(met, "query_id long, id long, score double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
