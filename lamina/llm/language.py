"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. An n-gram's vector binds (multiplies) the vectors of its letters,
each rolled by its place; a document's vector bundles (adds) the vectors of its n-grams, words being set off by one
blank; a language's prototype bundles those of its labelled documents. A document gets the language whose prototype
has the largest cosine with it, ties to the smaller name; the score is that cosine, not below 0.

A text is unlike a language if its cosine is below SHARE of what as many n-grams of that language would have. With
shares q of n-grams in a language, counts c in a text of n, that is n |q| / |c|, 1 at most. A vector that has nothing to
do with a prototype has a cosine around 0 with a spread of 1 / sqrt(dims). Where the bound is within SPREADS of that, or
the text has less than FEWEST effective n-grams (n^2 / |c|^2), it is too short to tell, and like any language.

Texts that are null or hold no letter get `und` and 0, as does every text if no row has a label. Repeated rows count
as often as they occur. Other columns are not looked at; an empty table gives an empty one. Whole texts are used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import slices

UNDETERMINED = "und"
#: n-gram vectors that a worker keeps, at most.
KEPT = 20_000
SHARE, SPREADS, FEWEST = 1 / 3, 3, 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """True at the code point of each letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Space:
    """Vectors of letters and n-grams, made when first met."""

    def __init__(self, dims: int = 1024, n: int = 3, seed: int = 7):
        self.dims, self.n, self.seed = dims, n, seed
        self.letter: dict[int, np.ndarray] = {}
        self.keys = np.empty(0, np.int64)  # sorted
        self.rows = np.empty(0, np.int64)
        self.vectors = np.empty((0, dims), np.int8)

    def of_letter(self, c: int) -> np.ndarray:
        if (v := self.letter.get(c)) is None:
            v = self.letter[c] = (np.random.default_rng([self.seed, c]).integers(0, 2, self.dims) * 2 - 1).astype(np.int8)
        return v

    def bound(self, key: int) -> np.ndarray:
        out = np.ones(self.dims, np.int8)
        for place in range(self.n):
            out *= np.roll(self.of_letter(key & 0x1FFFFF), place)
            key >>= 21
        return out

    def of_ngrams(self, keys: np.ndarray) -> np.ndarray:
        """A float32 row for each of the sorted keys."""
        at = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        hit[inside] = self.keys[at[inside]] == keys[inside]
        if not hit.all():
            if len(self.keys) + (~hit).sum() > KEPT:
                self.keys, self.rows, self.vectors = self.keys[:0], self.rows[:0], self.vectors[:0]
                hit[:] = False
            new = keys[~hit]
            made = np.array([self.bound(int(k)) for k in new], np.int8).reshape(len(new), self.dims)
            self.rows = np.concatenate([self.rows, np.arange(len(new)) + len(self.vectors)])
            self.vectors = np.concatenate([self.vectors, made])
            self.keys = np.concatenate([self.keys, new])
            order = np.argsort(self.keys)
            self.keys, self.rows = self.keys[order], self.rows[order]
            at = np.searchsorted(self.keys, keys)
        return self.vectors[self.rows[at]].astype(np.float32)

    def ngrams(self, text: str) -> np.ndarray:
        """Key of each n-gram: 21 bits for each letter, 0 for the blank between words; empty if there is no letter."""
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        c[~letters()[c]] = 0
        c = np.concatenate([[0], c, [0]])
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
        if len(c) < self.n or not c.any():
            return np.empty(0, np.int64)
        key = np.zeros(len(c) - self.n + 1, np.int64)
        for place in range(self.n):
            key |= c[place : len(c) - self.n + 1 + place] << (21 * place)
        return key

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """A float32 row for each text, 0 for one without letters."""
        return self.counted(texts)[0]

    def counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A float32 row for each text, the number of its n-grams, and the sum of their squared counts."""
        squares = np.zeros(len(texts))
        out = np.zeros((len(texts), self.dims), np.float32)
        grams = [self.ngrams(t or "") for t in texts]
        at = 0
        while at < len(texts):  # by some 100,000 letters at once
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(grams[end]) <= 100_000 and end - at < 48):
                size += len(grams[end])
                end += 1
            if size:
                keys, place = np.unique(np.concatenate(grams[at:end]), return_inverse=True)
                rows = np.repeat(np.arange(end - at), [len(g) for g in grams[at:end]])
                counts = np.bincount(rows * len(keys) + place, minlength=(end - at) * len(keys)).reshape(end - at, len(keys))
                squares[at:end] = (counts.astype(np.float64) ** 2).sum(axis=1)
                for k in range(0, len(keys), 4096):
                    out[at:end] += counts[:, k : k + 4096].astype(np.float32) @ self.of_ngrams(keys[k : k + 4096])
            at = end
        return out, np.array([len(g) for g in grams], np.float64), squares


@lru_cache(maxsize=2)
def space(dims: int, n: int, seed: int) -> Space:
    return Space(dims, n, seed)


class Profiles:
    """Prototypes of languages, learnt by fit() and applied by predict()."""

    def __init__(self, names: list[str], vectors: np.ndarray, dims: int, n: int, seed: int, grams: np.ndarray | None = None):
        self.names, self.dims, self.n, self.seed = names, dims, n, seed
        self.length = np.linalg.norm(vectors, axis=1) / np.sqrt(dims) / np.maximum(1, grams) if grams is not None and len(names) else np.zeros(len(names))  # |q|
        norm = np.linalg.norm(vectors, axis=1, keepdims=True) if len(names) else np.empty((0, 1))
        self.unit = (vectors / np.where(norm > 0, norm, 1)).astype(np.float32) if len(names) else vectors

    @classmethod
    def fit(cls, docs: DataFrame, label: str | Column = "lang", text: str = "text", dims: int = 1024, n: int = 3, seed: int = 7) -> Profiles:
        """Bundles all labelled rows. Each task sends a vector of sums for each language; Spark adds them by place."""

        def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for names, texts in slices(batches, 256):
                vectors, number, _ = space(dims, n, seed).counted(texts)
                vectors = np.column_stack([vectors.astype(np.float64), number])
                names = np.array(names, object)
                for name in set(names):
                    total[name] = total.get(name, 0) + vectors[names == name].sum(axis=0)
            if total:
                yield pa.RecordBatch.from_pydict({"name": pa.array(list(total), pa.string()), "v": pa.array([np.rint(v).astype(np.int64) for v in total.values()], pa.list_(pa.int64()))})

        label = F.col(label) if isinstance(label, str) else label
        rows = docs.select(label.alias("name"), F.col(text).alias("text")).where("name is not null and text is not null")
        sums = rows.mapInArrow(bundled, "name string, v array<bigint>").select("name", F.posexplode("v").alias("at", "v")).groupBy("name", "at").agg(F.sum("v").alias("v"))
        found: dict[str, np.ndarray] = {}
        for r in sums.collect():  # languages x (dims + 1) numbers, whatever the input's size
            found.setdefault(r["name"], np.zeros(dims + 1))[r["at"]] = r["v"]
        names = sorted(found)
        sums_ = np.array([found[x] for x in names]).reshape(len(names), dims + 1)
        return cls(names, sums_[:, :dims], dims, n, seed, sums_[:, dims])

    def judged(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """lang_pred, score and whether the text has letters and isn't unlike that language, which is true of any text with letters if there are no languages."""
        vectors, number, squares = space(self.dims, self.n, self.seed).counted(texts)
        if not self.names:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), (number > 0).tolist()
        vectors = vectors.astype(np.float64)
        norm = np.linalg.norm(vectors, axis=1)
        cosine = (vectors @ self.unit.T) / np.where(norm > 0, norm, 1)[:, None]
        best = cosine.argmax(axis=1)
        top = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        bound = SHARE * np.minimum(1, number * self.length[best] / np.sqrt(np.maximum(1, squares)))
        tells = (bound >= SPREADS / np.sqrt(self.dims)) & (number**2 >= FEWEST * squares)
        likely = (number > 0) & (~tells | (top >= bound))
        return [self.names[b] if n > 0 else UNDETERMINED for b, n in zip(best, norm, strict=True)], np.where(norm > 0, top, 0.0).tolist(), likely.tolist()

    def predict(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """key, lang_pred and score of each row."""

        def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, texts in slices(batches, 256):
                lang, score, _ = self.judged(texts)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["key", "lang_pred", "score"])

        rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        return rows.mapInArrow(predicted, "key long, lang_pred string, score double").withColumnRenamed("key", key)

    def likely_rows(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The rows, with all their columns, whose text isn't unlike the language it is most like."""

        def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                likely = [x for (texts,) in slices([batch.select([text])], 256) for x in self.judged(texts)[2]]
                yield batch.filter(pa.array(likely, pa.bool_()))

        return docs.mapInArrow(filtered, docs.schema)
