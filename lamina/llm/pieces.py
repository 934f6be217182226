"""SentencePiece encoding and decoding for merge-type vocabularies.

Adjacent symbol pairs wait in an agenda ordered by score, then place; the best is merged until none is left. A text is
cut before every run of spaces and around newlines, where no piece of the vocabulary reaches across (this is verified
as the model is loaded), so each part is worked out once per worker. The parts that a batch brings are checked
against the sentencepiece library, in one call.

Nulls count as empty texts: begin and end ids only, decoded to an empty text. Rows are independent: repeated rows give
equal rows, other columns are not looked at, an empty table gives an empty one, and a text may be of any length.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import LONGEST, slices, tokenizer_path

MARK = "▁"
RUNS = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
#: Parts that a worker keeps, at most.
CACHE = 700_000


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kind = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
            raise ValueError("only merge-type models without normalization are supported")
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        byte = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.byte = [byte[f"<0x{b:02X}>"] for b in range(256)]
        self.text = {i: p.piece.replace(MARK, " ").encode() for i, p in enumerate(model.pieces) if p.type == kind.NORMAL} | {i: bytes([b]) for b, i in enumerate(self.byte)}
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        if any(MARK in p.lstrip(MARK) or "\n" in p and p != "\n" for p in self.id):
            raise ValueError("a piece reaches across a cut")
        self.known: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}  # parts that aren't decoded to what they were

    def agenda(self, part: str) -> list[int]:
        """Ids of a part. An entry: score (negated), place and the merged piece; it is stale if the pair there has changed."""
        symbol, score, ids = list(part), self.score.get, self.id
        n = len(symbol)
        heap = [(-s, i, p) for i in range(n - 1) if (s := score(p := symbol[i] + symbol[i + 1])) is not None]
        if heap:
            heapq.heapify(heap)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while heap:
                _, i, piece = heapq.heappop(heap)
                j = after[i]
                if j >= n or not symbol[i] or symbol[i] + symbol[j] != piece:
                    continue
                symbol[i], symbol[j] = piece, ""
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (s := score(p := piece + symbol[k])) is not None:
                        heapq.heappush(heap, (-s, i, p))
                if (k := before[i]) >= 0 and (s := score(p := symbol[k] + piece)) is not None:
                    heapq.heappush(heap, (-s, k, p))
        out: list[int] = []
        for s in symbol:
            if s:
                if (i := ids.get(s)) is not None:
                    out.append(i)
                else:
                    out += [self.byte[b] for b in s.encode()]
        return out

    def decoded(self, ids: list[int]) -> str:
        """Text of ids, with the leading space that encoding adds. Ids of control pieces have none."""
        return b"".join([self.text.get(i, b"") for i in ids]).decode("utf-8", "replace")

    def parts(self, text: str) -> list[str]:
        """Parts of the text with marks for spaces, each mark at a part's start."""
        if not text:
            return []
        text = MARK + text.replace(" ", MARK)
        return RUNS.findall(text)

    def learn(self, parts: set[str]) -> None:
        """Encodes new parts and checks them against the library."""
        if len(self.known) + len(parts) > CACHE:
            self.known.clear()
            self.odd.clear()
        new = list(parts)
        marked = [p[0] == MARK for p in new]
        theirs = self.library.encode([p[1:].replace(MARK, " ") if m else "\n" + p for p, m in zip(new, marked, strict=True)], num_threads=1)
        for p, m, check in zip(new, marked, theirs, strict=True):
            ids = self.agenda(p)
            # A bare mark has no text besides it: the library is given an empty text and returns no ids.
            if p != MARK and ids != (check if m else check[2:]):
                raise ValueError(f"the sentencepiece library encodes {p!r} otherwise")
            self.known[p] = b"".join([i.to_bytes(4, "little") for i in ids])
            if (back := self.decoded(ids)) != p.replace(MARK, " "):
                self.odd[p] = back

    def batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids as little-endian 32-bit integers, begin and end included, and the decoded text, for each text."""
        every = [self.parts(t) for t in texts]
        if new := {p for parts in every for p in parts if p not in self.known}:
            if len(self.known) + len(new) > CACHE:
                new = {p for parts in every for p in parts}
            self.learn(new)
        long = [p for p in new if len(p) > LONGEST]
        begin, end = self.begin.to_bytes(4, "little"), self.end.to_bytes(4, "little")
        get, odd = self.known.__getitem__, self.odd
        out = []
        for parts in every:
            back = "".join([odd.get(p, p) for p in parts] if odd else parts).replace(MARK, " ")
            out.append((begin + b"".join(map(get, parts)) + end, back[1:] if back[:1] == " " else back))
        for p in long:  # so that the number of parts bounds their bytes
            del self.known[p]
            odd.pop(p, None)
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_pieces(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids (binary: little-endian unsigned 32-bit) and decoded of each row."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in slices(batches):
            out = codec(path).batch(texts)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "ids": pa.array([x for x, _ in out], pa.binary()), "decoded": pa.array([x for _, x in out], pa.string())})

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(encoded, "key long, ids binary, decoded string").select(F.col("key").alias(key), "ids", "decoded")


def piece_digests(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of each row of encode_pieces."""
    rows = encode_pieces(docs, path, text, key)
    return rows.select(key, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
