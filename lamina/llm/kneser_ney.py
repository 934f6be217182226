"""Interpolated modified Kneser-Ney model of word n-grams of any order, for perplexity.

Tasks hash words and count n-grams of some megabytes of text at once; the counts are shuffled as blocks of bytes, by the
n-gram's context (all words but the last), so that what a context's words add up to is known in one place. Contexts of
words that are all very frequent are spread by their last word over several places. Each part is summed and stored in
the shared folder, and passes on what it adds to the counts of the n-grams without their first word, which are summed
and stored likewise, down to words. Workers map these files into memory to score texts; only totals come to the driver.
Below the highest order, an n-gram counts the distinct words before it; one that begins a text counts as often as it
occurs.

A table is a sorted hash array: an index by the first bits of the hash, the next 32 bits, and numbers as bytes (large
ones stand in a second array). A context that is followed by one word, once, isn't stored: it is known from the n-gram
that it is. In shuffled blocks, frequent words have 16-bit codes; which words these are is learnt from a bounded sample of
rows, and plays no part in the result.

Words are the runs of bytes other than white space (0x20, 0x09 to 0x0D), A to Z in lower case, and an end. A null text
counts as empty: it has its end. Words are hashed to 48 bits, longer n-grams to 64, of which tables keep some 50. Unknown words share one place in the
vocabulary. Repeated rows count as often as they occur; other columns are not looked at; an empty table gives an empty
one; without training texts each token has probability 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import mapped, shared_dir, slices, store_arrays
from lamina.llm.neardup import MULTIPLIER, U, mixed, powers

BEGIN, END = U(1), U(2)
#: Order of the registered query.
ORDER = 3
#: Tokens whose n-grams a task counts at once, and bytes of text for each part of the tables; both as of order 2, fewer of higher ones.
TOKENS, PART_BYTES = 3_000_000, 16 << 20
#: Rows that frequent words are learnt from, how many of them have codes, and how many make hot contexts.
SAMPLE, CODES, HOT = 10_000, 65_533, 1024
#: Places that the n-grams of a hot context are spread over.
SPREAD = 16


def word_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hash of each word, each text ended by END, and the number of tokens of each text."""
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes: A-Z only
    c = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    inside = ~((c == 32) | ((c >= 9) & (c <= 13)))
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(np.cumsum([len(d) + 1 for d in data]), start, side="right")
    number = np.bincount(owner, minlength=len(texts))
    keys = np.full(len(start) + len(texts), END, U)
    if len(start):
        length = end - start
        first = np.cumsum(length) - length
        place = np.arange(length.sum()) - np.repeat(first, length)
        value = (c[inside].astype(U) + U(1)) * powers()[place & 0xFFFF] + (place >> 16).astype(U)
        keys[np.arange(len(start)) + owner] = np.maximum(mixed(np.add.reduceat(value, first) + length.astype(U)) >> U(16), U(3))
    return keys, number + 1


def gram_keys(words: list[np.ndarray]) -> np.ndarray:
    """Hash of each n-gram, its words given by place; a single word is its own."""
    key = words[0]
    for w in words[1:]:
        key = mixed(mixed(key) + w * MULTIPLIER)
    return key


def grams(keys: np.ndarray, number: np.ndarray, order: int) -> list[np.ndarray]:
    """The words of the n-gram that ends at each token, by place; BEGIN stands before each text."""
    place = np.arange(len(keys)) - np.repeat(np.cumsum(number) - number, number)
    out = [keys]
    for back in range(1, order):
        before = np.full_like(keys, BEGIN)
        on = np.flatnonzero(place >= back)
        before[on] = keys[on - back]
        out.insert(0, before)
    return out


class Codes:
    """16-bit codes of frequent words, by falling frequency from 1; 0 is any other word."""

    def __init__(self, words: np.ndarray):
        order = np.argsort(words)
        self.words, self.codes = words[order], (order + 1).astype(np.uint16)
        self.by_code = np.concatenate([np.zeros(1, U), words])

    def of(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.codes[at], np.uint16(0))


def planes(x: np.ndarray, size: int) -> bytes:
    """The low bytes of integers, all first bytes before all second ones, which compresses well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def unplanes(data: bytes, size: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(size, n).T
    return out.view("<u8").ravel()


def blocked(codes: list[np.ndarray], words: list[np.ndarray], columns: list[np.ndarray]) -> bytes:
    """n-grams as codes, the words that have none, and numbers, compressed."""
    head, body = [len(codes[0])], []
    for c, w in zip(codes, words, strict=True):
        rare = w[c == 0]
        head.append(len(rare))
        body += [planes(c, 2), planes(rare, 6)]
    for x in columns:
        head.append((int(x.max()).bit_length() + 7) // 8)
        body.append(planes(x, head[-1]))
    return zstandard.ZstdCompressor(level=3).compress(np.array(head, "<u4").tobytes() + b"".join(body))


def unblocked(data: bytes, n_words: int, n_columns: int, codes: Codes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    head = np.frombuffer(data, "<u4", 1 + n_words + n_columns).tolist()
    n, at, out = head[0], 4 * len(head), []
    for rare in head[1 : 1 + n_words]:
        c = unplanes(data[at : at + 2 * n], 2, n).astype(np.int64)
        at += 2 * n
        word = codes.by_code[c]
        word[c == 0] = unplanes(data[at : at + 6 * rare], 6, rare)
        at += 6 * rare
        out.append(word)
    for size in head[1 + n_words :]:
        out.append(unplanes(data[at : at + size * n], size, n))
        at += size * n
    return out


def each_part(part: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part, and the places that have it; order: all places by part."""
    sorted_ = part[order].astype(np.int64)
    edge = np.flatnonzero(np.diff(sorted_, prepend=-1)).tolist()
    for a, b in zip(edge, [*edge, len(part)][1:], strict=True):
        yield int(sorted_[a]), order[a:b]


def by_part(part: np.ndarray, words: list[np.ndarray], columns: list[np.ndarray], bits: int, codes: Codes) -> Iterator[tuple[int, bytes]]:
    """n-grams cut into a block for each part; in it like words stand together, which compresses well."""
    own = [codes.of(w) for w in words]
    alike = np.zeros(len(part), U)
    for k in range(3):
        alike = (alike << U(16)) | (own[k] if k < len(own) else np.zeros(len(part), np.uint16)).astype(U)
    order = np.argsort((part << U(48)) | alike if bits <= 16 else (part << U(64 - bits)) | (alike >> U(bits - 16)))
    for p, some in each_part(part, order):
        yield p, blocked([c[some] for c in own], [w[some] for w in words], [x[some] for x in columns])


def summed(key: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys, sums of the columns, and a place of each key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[at], [np.add.reduceat(x[order], at) if len(key) else x for x in columns], order[at]


def joined_blocks(batches: Iterator[pa.RecordBatch], part: int, words: int, columns: int, order: int, codes: Codes) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of the part that this task has, and the sum of the rows' counts of counts."""
    blocks = [[np.empty(0, U)] * (words + columns)]
    levels = np.zeros(4 * order, np.int64)
    for batch in batches:
        for own, data, level in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), batch.column("levels").to_pylist(), strict=True):
            if own != part:
                raise ValueError("a block was dealt to another part")
            blocks.append(unblocked(data, words, columns, codes))
            levels += np.array(level or [0] * 4 * order, np.int64)
    return [np.concatenate(x) for x in zip(*blocks, strict=True)], levels


def levels_of(count: np.ndarray) -> list[int]:
    return [int((count == n).sum()) for n in (1, 2, 3, 4)]


ROW = "part int, data binary, levels array<long>"


def row(parts: list[tuple[int, bytes, list[int] | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in parts], k) for i, k in enumerate([pa.int32(), pa.binary(), pa.list_(pa.int64())])], names=["part", "data", "levels"])


def discounts(levels: list[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of counts of 1 to 4."""
    one, two, three, four = levels
    share = one / (one + 2 * two) if one + 2 * two else 0.5
    ratio = lambda a, b: a / b if b else 0.5
    return [min(k, max(0.0, k - (k + 1) * share * ratio(a, b))) for k, a, b in ((1, two, one), (2, three, two), (3, four, three))]


#: Numbers are stored as bytes; rows with one from this on stand in a second table too.
LARGE = 255


def index_bits(n: int) -> int:
    return max(1, n.bit_length() - 3)


def store_table(folder: str, name: str, part: int, key: np.ndarray, columns: list[np.ndarray]) -> None:
    """Keys (64 bits, distinct, sorted) and numbers of a part."""
    large = np.max(columns, axis=0) >= LARGE if len(key) else np.zeros(0, bool)
    for kind, own, data in (("", key, [np.minimum(x, LARGE).astype(np.uint8) for x in columns]), ("-large", key[large], [x[large].astype("<u8") for x in columns])):
        bits = index_bits(len(own))
        first = np.searchsorted(own >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U)).astype("<u4")
        store_arrays(f"{folder}/{name}{kind}-{part}", [first, (own >> U(32 - bits)).astype("<u4"), *data])


def found_in(arrays: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys a stored table has, and their places there."""
    first, rest, *_ = arrays
    bits = index_bits(len(rest))
    bucket = (keys >> U(64 - bits)).astype(np.int64)
    low, high = first[bucket].astype(np.int64), first[bucket + 1].astype(np.int64)
    want = (keys >> U(32 - bits)).astype(np.uint32)
    if not len(rest):
        return np.zeros(len(keys), bool), low
    step = 1 << int((high - low).max(initial=0)).bit_length()
    while step := step >> 1:  # how many of the bucket are less, from the highest bit down
        probe = low + (step - 1)
        low += step * ((probe < high) & (rest.take(probe, mode="clip") < want))
    return (low < high) & (rest.take(low, mode="clip") == want), low


@dataclass
class Model:
    folder: str
    bits: int  # parts: 2 ** bits
    order: int
    hot: np.ndarray  # frequent words, by falling frequency
    discounts: list[list[float]] = field(default_factory=list)  # of n-grams by n - 1
    tokens: int = 0  # N
    vocabulary: int = 0  # V
    pairs: int = 0  # distinct pairs of words
    rest: float = 1.0  # share of the words' level that goes to the uniform one

    def place(self, context: list[np.ndarray], last: np.ndarray | int) -> np.ndarray:
        """Hash of a context, and of its last word's group if the context is hot: its first bits are the part."""
        return mixed(mixed(gram_keys(context)) + np.where(self.is_hot(context), last, 0).astype(U) * MULTIPLIER)

    def is_hot(self, context: list[np.ndarray]) -> np.ndarray:
        """Whether all words are among the most frequent ones, of which fewer count in longer contexts."""
        hot = np.sort(self.hot[: max(2, len(self.hot) >> 4 * (len(context) - 1))])
        out = np.ones(len(context[0]), bool)
        for w in context:
            some = np.flatnonzero(out)
            out[some] = hot.take(np.searchsorted(hot, w[some]), mode="clip") == w[some]
        return out

    def part(self, place: np.ndarray) -> np.ndarray:
        return place >> U(64 - self.bits)

    def look_up(self, table: str, part: np.ndarray, keys: np.ndarray, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which keys are stored, and their numbers, 0 where they aren't."""
        on, out = np.zeros(len(keys), bool), [np.zeros(len(keys), np.int64) for _ in range(columns)]
        if not self.tokens:  # Spark need not run tasks over no rows, so there may be no files
            return on, out
        for p, some in each_part(part, np.argsort(part.astype(np.uint16 if self.bits <= 16 else np.uint32), kind="stable")):
            for kind, type_ in (("", "u1"), ("-large", "<u8")):
                arrays = mapped(f"{self.folder}/{table}{kind}-{p}", ("<u4", "<u4", *[type_] * columns))
                hit, at = found_in(arrays, keys[some])
                some, at = some[hit], at[hit]
                on[some] = True
                for x, c in zip(out, arrays[2:], strict=True):
                    x[some] = c[at]
                some = some[np.max([x[some] for x in out], axis=0) == LARGE] if len(some) else some
                if not len(some):
                    break
        return on, out

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of words: whether they are known, their counts, and the distinct words before them."""
        own = mixed(keys)
        return self.look_up("words", self.part(own), own << U(self.bits), 2)

    def grams(self, words: list[np.ndarray]) -> np.ndarray:
        """Counts of n-grams of two words or more, 0 of unknown ones."""
        return self.look_up(f"grams{len(words)}", self.part(self.place(words[:-1], mixed(words[-1]) % U(SPREAD))), gram_keys(words), 1)[1][0]

    def contexts(self, words: list[np.ndarray], known: np.ndarray) -> np.ndarray:
        """Of contexts, in rows: tokens after them, and words that follow once, twice, more often. known: whether they occur, as n-grams."""
        hot = self.is_hot(words)
        total = np.zeros((4, len(hot)), np.int64)
        some = np.concatenate([np.flatnonzero(known & ~hot), np.repeat(np.flatnonzero(hot), SPREAD)])
        place = self.place([w[some] for w in words], np.concatenate([np.zeros(int((known & ~hot).sum()), np.int64), np.tile(np.arange(SPREAD), int(hot.sum()))]))
        for x, column in zip(total, self.look_up(f"contexts{len(words) + 1}", self.part(place), place << U(self.bits), 4)[1], strict=True):
            np.add.at(x, some, column)
        total[:2, ~hot & (total[0] == 0) & known & (words[-1] != END)] = 1
        return total

    def scores(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text."""
        keys, number = word_keys(texts)
        every = grams(keys, number, self.order)
        begins = np.zeros(len(keys), bool)
        begins[np.cumsum(number) - number] = True
        own, at, gram = np.unique(keys, return_index=True, return_inverse=True)
        _, (count, spread) = self.words(own)
        base = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))[gram]
        n_known = (count > 0)[gram]
        cut = lambda n, d: np.maximum(0, n - np.array([0.0, *d])[np.minimum(n, 3)])
        p = (cut(spread, self.discounts[0]) / max(1, self.pairs) + self.rest / (self.vocabulary + 1))[gram]
        seen = count
        for n in range(2, self.order + 1):
            # The context of a token is the shorter n-gram at the token before; at a text's first one, it is BEGINs only.
            d, words = self.discounts[n - 1], every[self.order - n :]
            total, one, two, more = self.contexts([w[at] for w in words[1:]], seen > 0)[:, np.roll(gram, 1)]
            first = self.contexts([np.array([BEGIN])], np.zeros(1, bool)) if n == 2 else np.zeros((4, 1), np.int64)
            for x, y in zip((total, one, two, more), first, strict=True):
                x[begins] = y[0]
            left = np.where(total > 0, (d[0] * one + d[1] * two + d[2] * more) / np.maximum(1, total), 1)
            _, at, gram = np.unique(gram_keys(words), return_index=True, return_inverse=True)
            seen = self.grams([w[at] for w in words])
            p = cut(seen, d)[gram] / np.maximum(1, total) + left * p  # what a longer context leaves goes to the shorter one
        owner = np.repeat(np.arange(len(texts)), number)
        add = lambda x: np.bincount(owner, x, len(texts))
        return number, add(n_known.astype(float)).astype(np.int64), add(base), add(np.log10(p))


def frequent_words(texts: DataFrame, rows: int) -> np.ndarray:
    """Hashes of the most frequent words of a sample of the rows (column text), BEGIN and END first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (some,) in slices(batches, 1000, 4 << 20):
            word, n = np.unique(word_keys(some)[0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": pa.array(word.view(np.int64)), "n": pa.array(n, pa.int64())})

    sample = texts if rows <= SAMPLE else texts.sample(SAMPLE / rows, seed=3)
    found = sample.mapInArrow(counted, "word long, n long").where(F.col("word") > int(END)).groupBy("word").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "word").limit(CODES).collect()  # CODES rows, whatever the input's size
    return np.array([int(BEGIN), int(END), *[r["word"] for r in top]], U)


def fit(docs: DataFrame, text: str = "text", part_bytes: int = PART_BYTES, tokens: int = TOKENS, order: int = 2, hot: int = HOT) -> Model:
    """Counts all rows and stores the tables, from the highest order (2 or more) down. hot: frequent words that make hot contexts."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    size, rows = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    bits = min(20, max(6, ((size or 0) * order // (2 * part_bytes)).bit_length()))
    frequent = frequent_words(texts, rows)
    folder = shared_dir(docs.sparkSession)
    parts, most = 1 << bits, max(1, tokens * 2 // order)
    model = Model(folder, bits, order, frequent[:hot])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held = Codes(frequent), []

        def sent() -> pa.RecordBatch:
            words = grams(*(np.concatenate(x) for x in zip(*held, strict=True)), order)
            held.clear()
            _, at, n = np.unique(gram_keys(words), return_index=True, return_counts=True)
            words = [w[at] for w in words]
            part = model.part(model.place(words[:-1], mixed(words[-1]) % U(SPREAD)))
            return row([(p, data, None) for p, data in by_part(part, words, [n.astype(U)], bits, codes)])

        size = 0
        for (some,) in slices(batches, 1000, 4 << 20):
            held.append(word_keys(some))
            size += len(held[-1][0])
            if size >= most:
                yield sent()
                size = 0
        if held:
            yield sent()

    def level(k: int):  # noqa: ANN202
        """Sums k-grams and stores them and their contexts; passes on what they add to those without their first word."""
        inner = k < order

        def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = TaskContext.get().partitionId()
            codes = Codes(frequent)
            columns, levels = joined_blocks(batches, own, k, 2 if inner else 1, order, codes)
            key, sums, at = summed(gram_keys(columns[:k]), columns[k:])
            words = [w[at] for w in columns[:k]]
            del columns
            raw = sums[0]
            # Nothing stands before a text, so what begins one counts as often as it occurs.
            n = np.where(words[0] == BEGIN, raw, sums[1]) if inner else raw
            real = words[1] != BEGIN  # with several BEGINs: only passed on
            store_table(folder, f"grams{k}", own, key[real], [n[real]])
            levels[4 * k - 4 : 4 * k] += levels_of(n[real])
            context = [w[real] for w in words[:-1]]
            place, data, at = summed(model.place(context, mixed(words[-1][real]) % U(SPREAD)), [x.astype(U) for x in (n[real], n[real] == 1, n[real] == 2, n[real] > 2)])
            kept = (data[0] > 1) | model.is_hot([w[at] for w in context])
            key, order_ = place[kept] << U(bits), np.argsort(place[kept] << U(bits))
            store_table(folder, f"contexts{k}", own, key[order_], [x[kept][order_] for x in data])
            key, data, at = summed(gram_keys(words[1:]), [raw, np.ones(len(raw), U)])
            words = [w[at] for w in words[1:]]
            part = model.part(model.place(words[:-1], mixed(words[-1]) % U(SPREAD)) if k > 2 else mixed(words[0]))
            yield row([(p, data, levels.tolist() if i == 0 else None) for i, (p, data) in enumerate(by_part(part, words, data, bits, codes))])

        return stored

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        (key, *columns), levels = joined_blocks(batches, own, 1, 2, order, Codes(frequent))
        key, columns, _ = summed(mixed(key) << U(bits), columns)
        store_table(folder, "words", own, key, columns)
        n, spread = (x.astype(np.int64) for x in columns)
        levels[:4] += levels_of(spread)
        sums = [n.sum(), (n > 0).sum(), spread.sum(), (spread == 1).sum(), (spread == 2).sum(), (spread > 2).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([[*map(int, sums), *levels.tolist()]], pa.list_(pa.int64()))], names=["sums"])

    counted = texts.mapInArrow(count, ROW).repartitionById(parts, F.col("part"))
    for k in range(order, 1, -1):
        counted = counted.mapInArrow(level(k), ROW).repartitionById(parts, F.col("part"))
    sums = counted.mapInArrow(words, "sums array<long>")
    total = sums.select([F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(6 + 4 * order)]).first()
    t = [x or 0 for x in total]
    model.discounts = [discounts(t[at : at + 4]) for at in range(6, len(t), 4)]
    model.tokens, model.vocabulary, model.pairs = t[:3]
    model.rest = sum(a * b for a, b in zip(model.discounts[0], t[3:6], strict=True)) / model.pairs if model.pairs else 1.0
    return model


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_known, base_score and score of each row, both scores as logarithms to base 10."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in slices([batch], 4000, 6 << 20):
                n, known, base, own = model.scores(texts)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(known), pa.array(base), pa.array(own)], names=["key", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(scored, "key long, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("key", key)


def perplexity(score: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / n_tokens)
