"""Hierarchical multi-length packing.

Documents become token ids, ended by a separator. Blocks of the largest window are cut off at once; what is left of a
document is dealt to buckets of bounded size and, there, routed to the smallest tier (power of two) that holds it. Each
tier is packed from the longest: a window opens with its own document, then takes the longest shorter documents that
fit, and a last one is cut to fill it. When no shorter document is left, the next of the same tier is cut. The one
window of a bucket that stays open is cut into powers of two, so nothing is padded. A bucket's windows then form as
many step groups as fit best, each window, longest first, going to the group with the fewest tokens: groups of a bucket
differ by a window at most, and no bucket leaves a short one over.

A null text counts as empty: its one token is the separator. Repeated rows and ids are separate documents. Other
columns are not looked at; an empty table gives an empty one. Texts may be of any length.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import Recent, slices, tokenizer_path
from lamina.llm.tokens import byte_symbols

WINDOW = 4096
TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 16 * WINDOW
#: Bytes of text that go to a bucket, on average.
BUCKET_BYTES = 1_500_000
#: Parts of texts that a worker keeps the ids of: twice so many at most.
BITS = 300_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_id long"
PLAIN_SPACE = re.compile(r"[ \t\n\r]+")
#: Characters that the library's normalizer only lower-cases: ASCII and Latin letters without a dotted capital I.
ODD = re.compile("[^\t\n\r -~\xc0-\u012f\u0131-\u017f]")
#: The library's split of such a text in lower case: endings, letters, single digits, runs of others; white space goes.
PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\xdf-\xf6\xf8-\u017f]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-\u017f]+")


class WordIds:
    """Ids of texts, as bytes. The library's own model merges the symbols of a part, once for each part that is kept.

    Its normalizer and splitter are applied here to words of common letters, and by the library to all others: white
    space always separates words for this tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.wide, self.code = ("<u2", "H") if self.whole.get_vocab_size() <= 0x10000 else ("<u4", "I")
        self.symbol = str.maketrans({chr(b): c for b, c in enumerate(byte_symbols())})
        self.bits = Recent(self.bit, BITS)

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def bit(self, text: str) -> bytes:
        shown = text if text.isascii() else text.encode().decode("latin-1").translate(self.symbol)
        return self.packed([t.id for t in self.model.tokenize(shown)])

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.bits.__getitem__, PARTS.findall(text.lower())))

    def ids(self, text: str) -> bytes:
        if "<|" not in text and not ODD.search(text):
            return self.plain(text)
        odd = lambda w: "<|" in w or ODD.search(w)
        return b"".join([self.packed(self.whole.encode(w, add_special_tokens=False).ids) if odd(w) else self.plain(w) for w in PLAIN_SPACE.split(text) if w])


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tier_of(length: int, tiers: tuple[int, ...]) -> int:
    return next((t for t in tiers if length <= t), tiers[-1])


def packed_windows(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length), all full: their lengths are tiers, or powers of two for the last one's parts.

    lengths: of documents, each at most the largest tier.
    """
    wait: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, document, start), ascending
    for i, n in enumerate(lengths):
        if n:
            wait[tier_of(n, tiers)].append((n, i, 0))
    for q in wait.values():
        q.sort()
    out: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for level in range(len(tiers) - 1, -1, -1):
        size = tiers[level]
        while wait[size]:
            n, i, start = wait[size].pop()
            window, gap = [(i, start, n)], size - n
            while gap:
                found = None
                for t in reversed(tiers[: level + 1]):  # the longest that fits
                    q = wait[t]
                    if q and (at := bisect_right(q, (gap, float("inf"), 0))):
                        found = q.pop(at - 1)
                        break
                if found is None:  # none fits: the shortest one is cut
                    q = next((wait[t] for t in tiers[: level + 1] if wait[t]), None)
                    if q is None:
                        break
                    n, i, start = q.pop(0)
                    found = (gap, i, start)
                    insort(wait[tier_of(n - gap, tiers)], (n - gap, i, start + gap))
                window.append((found[1], found[2], found[0]))
                gap -= found[0]
            if gap:
                rest = window
            else:
                out.append(window)
    total = sum(n for *_, n in rest)
    for size in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
        window, need = [], size
        while need:
            i, start, n = rest.pop(0)
            if n > need:
                rest.insert(0, (i, start + need, n - need))
                n = need
            window.append((i, start, n))
            need -= n
        out.append(window)
    return out


def balanced(sizes: list[int], step: int) -> list[int]:
    """The step group of each window: as many groups as bring their tokens closest to a step, equally filled."""
    groups = [(0, g) for g in range(max(1, round(sum(sizes) / step)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        filled, out[i] = heappop(groups)
        heappush(groups, (filled + sizes[i], out[i]))
    return out


def pack(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", separator: int = 2, tiers: tuple[int, ...] = TIERS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Pieces: a row for each run of a document's ids in a sequence, with the sequence's length and step group.

    tiers: powers of two, ascending. One shuffle moves the ids that are left of documents after whole windows.
    """
    path, window = path or tokenizer_path("word_bpe_49k.json"), tiers[-1]
    step = STEP_TOKENS * window // WINDOW

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        salt = 0
        for keys, texts in slices(batches):
            rows = []
            for k, t in zip(keys, texts, strict=True):
                ids = np.frombuffer(encoder.ids(t) + encoder.packed([separator]), encoder.wide)
                whole = len(ids) // window * window
                rows += [(k, at, window, len(ids), crc(ids[at : at + window]), None, salt + at) for at in range(0, whole, window)]
                if whole < len(ids):
                    rows.append((k, whole, len(ids) - whole, len(ids), None, ids[whole:].tobytes(), salt + whole))
                salt += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "start", "length", "doc_tokens", "crc", "ids", "salt"])

    def packed(bucket: pa.Table) -> pa.Table:
        number = bucket.column("bucket")[0].as_py() << 24
        doc, start, length, tokens, sums, ids = (bucket.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "crc", "ids"))
        rest = [i for i, x in enumerate(ids) if x is not None]
        wide = encoder_width(path)
        made = [[(i, 0, window)] for i, x in enumerate(ids) if x is None]
        made += [[(rest[i], at, n) for i, at, n in w] for w in packed_windows([length[i] for i in rest], tiers)]
        sizes = [sum(n for *_, n in w) for w in made]
        group = balanced(sizes, step)
        rows = []
        for s, (w, size) in enumerate(zip(made, sizes, strict=True)):
            offset = 0
            for i, at, n in w:
                digest = sums[i] if ids[i] is None else crc(np.frombuffer(ids[i], wide)[at : at + n])
                rows.append((doc[i], start[i] + at, n, digest, tokens[i], number + s, offset, size, number + group[s]))
                offset += n
        return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(9)], names=[x.split()[0] for x in PIECE.split(", ")])

    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = total // bucket_bytes + 1
    rows = docs.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, crc long, ids binary, salt long")
    # The salt keeps rows of one id apart; it numbers a task's documents, so a task that runs again deals alike.
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "salt", "doc_tokens"), F.lit(buckets))).drop("salt")
    return rows.groupBy("bucket").applyInArrow(packed, PIECE)


def encoder_width(path: str) -> str:
    return word_ids(path).wide
