"""What the operators of this subpackage share: table access, the shared folder, Arrow batches, hot-key-free ids."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.sources.tables import shared_dir, written  # noqa: F401  also used by the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of so many rows at most: of long texts, 10,000 (the default) take tens of MB in the executor and again in its worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def free_name(names: list[str], wish: str) -> str:
    """The wish, with so many underscores that no column has this name, in any case."""
    taken = {n.lower() for n in names}
    while wish.lower() in taken:
        wish += "_"
    return wish


#: A key that more than one in so many rows have is a hot one; there are no more hot keys than this.
HOT = 1000
#: Bytes of a value that is broadcast.
HOT_BYTES = 1 << 16


def looked_up(rows: DataFrame, values: DataFrame, key: str, total: int | None = None, size: Column | None = None) -> DataFrame:
    """rows with the columns of values, null where a key has none: a left join that no hot key holds up.

    values has one row for each key, with a column n: the number of the key's rows. As these add up to all rows, at most
    HOT keys have more than a HOT-th of them; the values of these are broadcast, their rows (and those with a null key)
    stay where they are, and only rows of other keys meet theirs in a shuffle. So values should have the hot keys that
    have nothing to look up, too. rows is read twice, so it should be cheap to make. total: the number of rows. size:
    bytes of a value that may be long; a hot key whose value has more than HOT_BYTES goes the other keys' way, where
    Spark splits skewed partitions.
    """
    total = rows.count() if total is None else total
    names = rows.columns
    new = [c for c in values.columns if c not in (key, "n")]
    hot = F.col("n") > total / HOT
    if size is not None:
        hot = F.coalesce(hot & (F.coalesce(size, F.lit(0)) <= HOT_BYTES), F.lit(False))
    often = free_name([*names, *new], "often")
    value = F.struct(*new)
    met = rows.join(F.broadcast(values.where(hot).select(key, value.alias(often))), key, "left")  # HOT rows at most
    apart = F.col(often).isNotNull() | F.col(key).isNull()
    known = met.where(apart).select(*names, *[F.col(often)[c].alias(c) for c in new])
    asked = met.where(~apart).select(*names).join(values.where(~hot).select(key, *new), key, "left")
    return known.unionByName(asked.select(*names, *new))


def crc_fold(doc_id: Column, modulus: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000, text_bytes: int = 16 << 20) -> Iterator[list[list]]:
    """Columns of each batch as Python lists, in slices of so many rows and roughly so many bytes."""
    for batch in batches:
        size = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(rows, text_bytes // size))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield [c.to_pylist() for c in part.columns]


#: Longer keys aren't kept in caches, so that the number of keys bounds their bytes.
LONGEST = 64


class Recent(dict):
    """Values by key (a string), made when first asked for. When size keys are held, they become the older half and new ones are taken up; the half before is dropped, but for what was asked for meanwhile. Values of keys longer than LONGEST are made each time."""

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = self.copy()
            self.clear()
        self[key] = value
        return value


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def local_path(uri: str) -> str | None:
    """The path of a file of a mounted file system, or None for one of another store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def opened(uri: str):  # noqa: ANN201
    """A file that can be mapped into memory: of a shared mount in place, of another store a nameless copy, gone with its last map."""
    if path := local_path(uri):
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    target = tempfile.TemporaryFile()
    with store.open_input_stream(inner) as source:
        while chunk := source.read(8 << 20):
            target.write(chunk)
    target.seek(0)
    return target


def store_file(uri: str, data: Iterable[bytes]) -> None:
    """Writes a file of the shared folder under a name of its own, then renames it: a task that runs twice leaves one whole file."""
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as target:
            for x in data:
                target.write(x)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as target:
        for x in data:
            target.write(x)
    store.move(part, inner)


def store_arrays(uri: str, arrays: list[np.ndarray]) -> None:
    """A file of arrays: the length of each, as 8 bytes, then all of them."""
    store_file(uri, [np.array([len(x) for x in arrays], "<u8").tobytes(), *[x.tobytes() for x in arrays]])


@lru_cache(maxsize=4096)
def mapped(uri: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The arrays of a file of store_arrays(), mapped into memory. A file that isn't there is an error."""
    with opened(uri) as f:
        data = np.asarray(np.memmap(f, np.uint8, "r"))
    out, at = [], 8 * len(kinds)
    for k, n in zip(kinds, data[:at].view("<u8").tolist(), strict=True):
        size = n * np.dtype(k).itemsize
        out.append(data[at : at + size].view(np.dtype(k).base).reshape(n, *np.dtype(k).shape))
        at += size
    return out


@dataclass
class KeySet:
    """Keys (64-bit hashes) in the shared folder, as sorted arrays by their first bits, which workers map into memory.

    It stands in for a semi-join whose other side is too large to be shuffled again; no worker or driver holds it whole.
    Each key may have a value, which stands in for a join.
    """

    folder: str
    bits: int
    kinds: tuple[str, ...] = ("<u8",)
    size: int = 0

    @classmethod
    def store(cls, keys: DataFrame, count: int, part: int = 1 << 20) -> KeySet:
        """keys: one column of longs, distinct, and perhaps a second one of their values; count: their number."""
        folder, bits = shared_dir(keys.sparkSession), min(20, max(6, (count // part).bit_length()))

        def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = TaskContext.get().partitionId()
            held = [[np.asarray(c).view(np.uint64) for c in batch.columns] for batch in batches if batch.num_rows]
            columns = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.empty(0, np.uint64)] * len(kinds)
            if own >> bits or (columns[0] >> np.uint64(64 - bits) != own).any():
                raise ValueError("a key was dealt to another part")
            order = np.argsort(columns[0])
            # Parts without keys are written too, so that a file that isn't there is known to be lost.
            store_arrays(f"{folder}/keys-{own}", [x[order] for x in columns])
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(order)], pa.int64())})

        name, *value = keys.columns
        kinds = ("<u8", *["<i8"] * len(value))
        key = F.col(name)
        parts = keys.select(key.alias("key"), *value).repartitionById(1 << bits, F.shiftrightunsigned("key", 64 - bits).cast("int"))
        size = parts.mapInArrow(stored, "n long").agg(F.sum("n")).first()[0]
        return cls(folder, bits, kinds, size or 0)

    @classmethod
    def summed(cls, blocks: DataFrame, bits: int, held: int = 4 << 20) -> KeySet:
        """The sums, rounded, of the values of each key. blocks: rows of blocks_of(); a part sums its blocks as they come, so many rows at most beside its distinct keys."""
        folder = shared_dir(blocks.sparkSession)

        def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = TaskContext.get().partitionId()
            keys, values, size = [np.empty(0, np.uint64)], [np.empty(0)], 0

            def added() -> None:
                key, place = np.unique(np.concatenate(keys), return_inverse=True)
                values[:] = [np.bincount(place, np.concatenate(values), len(key))]
                keys[:] = [key]

            for batch in batches:
                for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    if part != own:
                        raise ValueError("a block was dealt to another part")
                    n = len(data) // 16
                    keys.append(np.frombuffer(data, "<u8", n))
                    values.append(np.frombuffer(data, "<f8", n, 8 * n))
                    size += n
                    if size > held:
                        added()
                        size = 0
            added()
            store_arrays(f"{folder}/keys-{own}", [keys[0], np.rint(values[0]).astype("<i8")])
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(keys[0])], pa.int64())})

        size = blocks.repartitionById(1 << bits, F.col("part")).mapInArrow(stored, "n long").agg(F.sum("n")).first()[0]
        return cls(folder, bits, ("<u8", "<i8"), size or 0)

    def blocks_of(self, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        """part, data: sorted keys and their values (floats) as a block of bytes for each part of a set that is dealt like this one."""
        edges = np.searchsorted(keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        parts = np.flatnonzero(np.diff(edges)).tolist()
        data = [keys[edges[p] : edges[p + 1]].tobytes() + values[edges[p] : edges[p + 1]].tobytes() for p in parts]
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key (unsigned) is in the set."""
        return self.found(keys)[0]

    def values(self, keys: np.ndarray, other: int) -> np.ndarray:
        """The value of each key (unsigned), or the other one where it is not in the set."""
        on, value = self.found(keys)
        return np.where(on, value, other)

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        sorted_ = keys[order]
        out, values = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        if not self.size:  # Spark need not run tasks over no rows, so there may be no files
            return out, values
        edges = np.searchsorted(sorted_ >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        for part in np.flatnonzero(np.diff(edges)):
            own = slice(edges[part], edges[part + 1])
            known, *value = mapped(f"{self.folder}/keys-{part}", self.kinds)
            if len(known):
                at = np.minimum(np.searchsorted(known, sorted_[own]), len(known) - 1)
                out[order[own]] = known[at] == sorted_[own]
                if value:
                    values[order[own]] = value[0][at]
        return out, values
