"""Token counts by heap-and-linked-list byte-pair merging.

The number of tokens of a word is its number of initial symbols minus its merges, so no identifiers are made.
Words are cut where a byte-level tokenizer always cuts, counted once per worker and added up.

Nulls count as empty texts, which have no tokens. Rows are independent: repeated rows and ids give equal rows,
other columns are not looked at, an empty table gives an empty one, and a text may be of any length.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import Recent, slices, tokenizer_path

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A single newline or space between two other characters always starts a token; a newline there is one by itself.
LINE, SPACE = re.compile(r"(?<=\S)\n(?=\S)"), re.compile(r"(?<=\S) (?=\S)")
#: Words that a worker keeps the counts of: twice so many at most, and as many at the start of lines.
CACHE = 500_000


def byte_symbols() -> list[str]:
    """The character that a byte-level vocabulary uses for each byte: printable Latin-1 stands for itself, others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class PairMerger:
    """Merge ranks by pair of symbol ids, and the counts of words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        self.start = [vocab[c] for c in byte_symbols()]
        self.rank, self.made = {}, []
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in merges):
            self.rank.setdefault(vocab[a] << 24 | vocab[b], len(self.made))
            self.made.append(vocab[a + b])
        names = [re.escape(t["content"]) for t in model.get("added_tokens", ())]
        self.special = re.compile("|".join(names)) if names else None
        self.first = Recent(self.word, CACHE)
        self.later = Recent(lambda w: self.word(" " + w), CACHE)

    def merged(self, data: bytes) -> int:
        """Symbols left of data. The heap holds rank and place of adjacent pairs; entries that a merge made stale are skipped."""
        start, rank, made = self.start, self.rank.get, self.made
        symbol = [start[b] for b in data]
        n = left = len(symbol)
        heap = [r << 40 | i for i in range(n - 1) if (r := rank(symbol[i] << 24 | symbol[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = pop(heap)
            i, r = top & 0xFFFFFFFFFF, top >> 40
            j = after[i]
            if j >= n or symbol[i] < 0 or rank(symbol[i] << 24 | symbol[j]) != r:
                continue
            new = symbol[i] = made[r]
            symbol[j] = -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := rank(new << 24 | symbol[k])) is not None:
                    push(heap, r << 40 | i)
            if (k := before[i]) >= 0 and (r := rank(symbol[k] << 24 | new)) is not None:
                push(heap, r << 40 | k)
        return left

    def word(self, text: str) -> int:
        if text.isascii() and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self.merged(text.encode())
        return sum(self.merged(t.encode()) for t in PATTERN.findall(text))

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        lines = LINE.split(text)
        total = len(lines) - 1
        first, later = self.first, self.later.__getitem__
        for line in lines:
            head, *words = SPACE.split(line) if " " in line else (line,)
            total += first[head] + sum(map(later, words))
        return total

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes and n_tokens of each row. path: a byte-level tokenizer.json; default byte_bpe_50k.json."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(path).count
        for keys, texts in slices(batches):
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "n_tokens": pa.array([count(t) for t in texts], pa.int64()), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64())})

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(counted, "key long, n_tokens long, n_bytes long").select(F.col("key").alias(key), "n_bytes", "n_tokens")
