"""Token ids as ORC files, in ascending order of document id.

Documents are dealt to parts by ranges of (id, hash of the text, number of the row), so that no id, however often it
stands there, fills a part; a part is sorted, encoded as it streams by, and written as one file. ORC keeps the ids as
run-length encoded integers, in stripes that tasks read apart, with an index of the least and largest document id of
each stripe and row group and a Bloom filter on it. A small table of the parts (at most MOST_PARTS rows) has the number
of ids before each, so a document's place among all ids follows from its place in its file; no pass over the ids needs
another document's.

Nulls: a null text is an empty one, whose one id is the separator; null ids come first. Repeated ids follow each other by
the hash of their texts; repeated rows are separate documents. Other columns are not looked at. An empty table gives
files without rows. Texts may be of any length; a text's ids are one row, so they must fit into a worker's memory.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.common import Recent, shared_dir, slices, tokenizer_path
from lamina.llm.tokens import LINE, SPACE, byte_symbols

SEPARATOR = 2
#: Bytes of text in a file, on average, and the largest number of files: beyond it, files grow.
PART_BYTES, MOST_PARTS = 32 << 20, 65_536
#: Bytes of a stripe before it is written, rows of a row group, and the share of absent ids that a Bloom filter lets pass.
STRIPE_BYTES, GROUP_ROWS, FALSE_SHARE = 16 << 20, 1000, 0.01
#: Parts of texts that a worker keeps the ids of: twice so many at most.
KEPT = 300_000
LETTERS = "a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-ſ"
#: What the byte-level split makes of a text of ASCII and Latin letters, and any character that needs the library's own.
PARTS = re.compile(rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
ODD = re.compile(f"[^\t\n\r -~{LETTERS}]")
ROW = "doc_id long, part int, at long, n_tokens int, ids array<int>"


class ByteIds:
    """Ids of texts, as unsigned 32-bit integers. The library encodes each part once, for as long as it is kept; texts with special strings are left to it whole, and words with uncommon characters word by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.code = "H" if self.whole.get_vocab_size() <= 0x10000 else "I"
        self.space = byte_symbols()[ord(" ")]
        self.symbol = str.maketrans({chr(b): c for b, c in enumerate(byte_symbols())})
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.part = Recent(self.made, KEPT)
        self.word = Recent(self.encoded, KEPT // 4)

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def made(self, part: str) -> bytes | None:
        """Ids of a part; None where uncommon characters may have cut it otherwise."""
        if part.isascii() and part[1:].isalnum() and part[0] == " ":
            shown = self.space + part[1:]
        elif ODD.search(part):
            return None
        else:
            shown = part.encode().decode("latin-1").translate(self.symbol)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def encoded(self, text: str) -> bytes:
        return self.packed(self.whole.encode(text, add_special_tokens=False).ids)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.part.__getitem__, PARTS.findall(text)))

    def bytes_of(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return self.encoded(text)
        try:
            return self.plain(text)
        except TypeError:  # a part without ids: the text has uncommon characters
            pass
        found, newline = [], self.plain("\n")
        for line in LINE.split(text):
            found.append(newline)
            found += [self.word[w] if ODD.search(w) else self.plain(w) for w in (f" {w}" if i else w for i, w in enumerate(SPACE.split(line)))]
        return b"".join(found[1:])

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.bytes_of(text), self.code).astype(np.uint32)


@lru_cache(maxsize=2)
def byte_ids(path: str) -> ByteIds:
    return ByteIds(path)


@dataclass
class TokenFiles:
    """ORC files of token ids in a folder: ids/ (a file for each part) and parts/ (the table of the parts)."""

    spark: SparkSession
    folder: str

    def stored(self) -> DataFrame:
        """The rows of the files, with places within their part."""
        return self.spark.read.schema(ROW).orc(f"{self.folder}/ids")

    def parts(self) -> DataFrame:
        """part, base (ids in the parts before it), n_ids, n_docs, and its least and largest doc_id."""
        return self.spark.read.schema("part int, base long, n_ids long, n_docs long, least long, largest long").orc(f"{self.folder}/parts")

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows of the files with start, their place among all ids, instead of that in their part."""
        base = F.broadcast(self.parts().select("part", "base"))  # MOST_PARTS rows at most
        return rows.join(base, "part").withColumn("start", F.col("base") + F.col("at")).drop("base", "part", "at")

    def rows(self) -> DataFrame:
        """doc_id, n_tokens, ids and start of all documents. Tasks read stripes."""
        return self.placed(self.stored())

    def lookup(self, wanted: list[int]) -> DataFrame:
        """The rows of some documents. Stripes and row groups whose index or Bloom filter has none of them aren't read."""
        return self.placed(self.stored().where(F.col("doc_id").isin(wanted)))

    def between(self, start: int, end: int) -> DataFrame:
        """doc_id, start and ids of the pieces of documents at places from start to before end. Only files that hold some are read beyond their indexes."""
        met = self.parts().where((F.col("base") < end) & (F.col("base") + F.col("n_ids") > start)).select("part", "base")
        on = met.agg(F.min("part"), F.max("part"), F.min("base")).first()
        if on[0] is None:
            return self.rows().where(F.lit(False)).select("doc_id", "start", "ids")
        near = self.stored().where(F.col("part").between(on[0], on[1]))
        near = near.where((F.col("part") > on[0]) | (F.col("at") + F.col("n_tokens") > F.lit(start - on[2])))
        found = self.placed(near).where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > start))
        first = F.greatest(F.lit(0), F.lit(start) - F.col("start"))
        length = F.least(F.col("n_tokens").cast("long"), F.lit(end) - F.col("start")) - first
        return found.select("doc_id", (F.col("start") + first).alias("start"), F.slice("ids", (first + 1).cast("int"), length.cast("int")).alias("ids"))


def written_ids(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", separator: int = SEPARATOR, folder: str | None = None, part_bytes: int = PART_BYTES, stripe_bytes: int = STRIPE_BYTES, group_rows: int = GROUP_ROWS) -> TokenFiles:
    """Encodes the texts and writes their ids. path: a byte-level tokenizer.json; default byte_bpe_50k.json. folder: default a new shared one."""
    spark, path = docs.sparkSession, path or tokenizer_path("byte_bpe_50k.json")
    folder = folder or shared_dir(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["doc_id", "hash", "row"]
    keyed = docs.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(min(MOST_PARTS, total // part_bytes + 1), *order).sortWithinPartitions(*order)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = byte_ids(path).ids, TaskContext.get().partitionId(), 0
        end = np.array([separator], np.uint32)
        for keys, texts in slices(batches):
            held = [x for t in texts for x in (encode(t), end)]
            size = np.array([len(held[i]) + 1 for i in range(0, len(held), 2)], np.int64)
            edges = np.concatenate([[0], np.cumsum(size)])
            ids = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(np.concatenate(held).view(np.int32)))
            columns = [pa.array(keys, pa.int64()), pa.array(np.full(len(keys), part, np.int32)), pa.array(at + edges[:-1]), pa.array(size.astype(np.int32)), ids]
            at += int(edges[-1])
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "at", "n_tokens", "ids"])

    rows = dealt.select("doc_id", "text").mapInArrow(encoded, ROW)
    how = {"compression": "zstd", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": group_rows, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_SHARE}
    rows.write.mode("overwrite").options(**how).orc(f"{folder}/ids")
    files = TokenFiles(spark, folder)
    parts = files.stored().groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n_ids"), F.count("*").alias("n_docs"), F.min("doc_id").alias("least"), F.max("doc_id").alias("largest"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part, MOST_PARTS at most
    parts.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"), "n_ids", "n_docs", "least", "largest").write.mode("overwrite").orc(f"{folder}/parts")
    return files


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of rows with ids."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            edges = np.asarray(lists.offsets).tolist()
            ids = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<i4")).cast("B")
            sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(edges, edges[1:], strict=False)]
            size = pa.array(np.diff(np.asarray(lists.offsets)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), size, pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(summed, "doc_id long, start long, n_tokens long, ids_crc32 long")
