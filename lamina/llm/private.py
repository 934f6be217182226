"""Information-theoretic sanitisation of personal data.

Values found by pattern (e-mail addresses, IP addresses, card and phone numbers) are protected entities, and so are
card and phone numbers within longer runs of digits, which fail the patterns. A term near one, within so many words, reveals it by their pointwise mutual information: PMI(t; e) = IC(e) - log2(df(t) / co(t, e)),
where df counts the distinct texts of the whole corpus that hold the term and co those where it stands near the entity.
Terms whose PMI / IC(e) reaches the disclosure threshold are generalised in the documents that name the entity, to a
class of terms (numbers keep their size), and removed if it reaches the second one. An entity that is named in one text
has the largest IC; what tells about its terms is then how rare they are in the corpus: PMI / IC(e) = 1 - log2(df(t)) /
log2(number of texts). Copies of a text count once. Only terms that stand near some entity are counted.

A null text counts as empty and stays null when sanitised. Equal texts get equal spans, whatever their ids. Rows are
told apart by their text alone, so null or repeated ids and other columns play no part; an empty table gives an empty
one. Whole texts are used. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import HOT, KeySet, free_name, looked_up, slices, written
from lamina.llm.neardup import word_hashes

KINDS = ("email", "ip", "card", "phone", "term", "removed")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Digits before a match can't be: matches end with a whole run of digits, so these patterns find what those without the look-behind do.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
GROUP = re.compile("[0-9]+")
WORD = re.compile(r"[^\W_]+")
NEAR, DISCLOSURE, REMOVAL = 5, 0.9, 0.98


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str, failed: list[re.Match] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), in order. failed: takes up matches for cards and phones that are neither."""
    out = []
    failed = [] if failed is None else failed
    at = text.find("@")
    last = 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
            elif len(digits) > 12:
                failed.append(m)
    if "+" in text:
        for m in PHONE.finditer(text):
            n = sum(c in "0123456789" for c in m[0])
            if 9 <= n <= 15:
                out.append((m.start(), 3, m.end()))
            elif n > 15:
                failed.append(m)
    return sorted(out)


def inner_spans(failed: list[re.Match]) -> list[tuple[int, int, int]]:
    """Cards and phones within matches that are too long or fail the check: unbroken groups of digits that are cards, and the longest start of a match, ended by a group, that is a phone."""
    out = []
    for m in failed:
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in GROUP.finditer(m[0])]
        if m[0][0] == "+":
            n, end = 0, None
            for a, b in groups:
                n += b - a
                if n > 15:
                    break
                end = b if n >= 9 else end
            if end is not None:
                out.append((m.start(), 3, end))
            continue
        out += [(a, 2, b) for a, b in groups if 12 <= b - a <= 19 and luhn(m[0][a - m.start() : b - m.start()])]
    return out


def all_spans(text: str) -> list[tuple[int, int, int]]:
    failed: list[re.Match] = []
    base = base_spans(text, failed)
    return sorted(base + inner_spans(failed)) if failed else base


def neighbours(text: str, spans: list[tuple[int, int, int]], near: int = NEAR) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Places of the words near each entity, by hashes of the entity and the word; each entity also has one pair with 0, without places."""
    words = [m.span() for m in WORD.finditer(text)]
    free = []
    at = 0
    covered = sorted((s, e) for s, _, e in spans)
    top = 0
    for s, e in words:
        while at < len(covered) and covered[at][0] < e:
            top = max(top, covered[at][1])
            at += 1
        if s >= top:
            free.append((s, e))
    starts = [s for s, _ in free]
    out: dict[tuple[int, int], set] = {}
    for s, kind, e in spans:
        entity = int.from_bytes(hashlib.blake2b(f"{KINDS[kind]}:{text[s:e].lower()}".encode(), digest_size=8).digest(), "little", signed=True)
        out.setdefault((entity, 0), set())
        k, j = bisect_left(starts, s), bisect_left(starts, e)
        for a, b in free[max(0, k - near) : k] + free[j : j + near]:
            h, _ = word_hashes([text[a:b]])
            if len(h) == 1:
                out.setdefault((entity, int(h.view(np.int64)[0])), set()).add((a, b))
    return {k: sorted(v) for k, v in out.items()}


def digest(text: str) -> Column:
    """128 bits that stand for the text."""
    return F.md5(F.col(text).cast("binary"))


def document_frequencies(docs: DataFrame, text: str, copies: KeySet, near: KeySet) -> KeySet:
    """df by term (hash), in distinct texts, of the terms in near: a text that stands n times (copies, by hash) counts 1 / n each time. A task adds up some megabytes of text before it sends a block of their terms to each part."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            word, weight = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            term, place = np.unique(word, return_inverse=True)
            weight = np.bincount(place, weight, len(term))
            on = near.contains(term)
            return near.blocks_of(term[on], weight[on])

        for digests, texts in slices(batches, 512, 4 << 20):
            weight = 1 / copies.values(np.array(digests, np.int64).view(np.uint64), 1)
            word, owner = word_hashes(texts)
            order = np.lexsort((word, owner))
            word, owner = word[order], owner[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
            held.append((word[new], weight[owner[new]]))
            size += len(held[-1][0])
            if size > 2_000_000:
                yield sent()
                size = 0
        if held:
            yield sent()

    rows = docs.select(F.xxhash64(text).alias("hash"), F.col(text).alias("text")).where("text is not null")
    return KeySet.summed(rows.mapInArrow(counted, "part int, data binary"), near.bits)


def candidates(docs: DataFrame, text: str, near: int) -> DataFrame:
    """digest (of the text), entity, term and places, a row for each distinct text and pair."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for digests, texts in slices(batches):
            rows = []
            for d, t in zip(digests, texts, strict=True):
                if spans := all_spans(t):
                    rows += [(d, e, w, [{"start": a, "end": b} for a, b in places]) for (e, w), places in neighbours(t, spans, near).items()]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["digest", "entity", "term", "places"])

    rows = docs.select(digest(text).alias("digest"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInArrow(found, "digest string, entity long, term long, places array<struct<start: long, end: long>>").groupBy("digest", "entity", "term").agg(F.first("places").alias("places"))


def revealing_terms(docs: DataFrame, text: str = "text", near: int = NEAR, disclosure: float = DISCLOSURE, removal: float = REMOVAL) -> DataFrame:
    """digest (of the text), terms: places whose words reveal an entity of the document, with kind 4 (generalise) or 5 (remove), and n, the rows that have the text. Texts that very many rows have are there without terms, too (see looked_up).

    The counts are looked up, not joined: common words and values would be the hot keys of a join.
    """
    pairs = written(candidates(docs, text, near))
    texts = written(docs.where(F.col(text).isNotNull()).groupBy(F.xxhash64(text).alias("hash"), digest(text).alias("digest")).agg(F.count("*").alias("n")))
    total, repeated, known = texts.agg(F.count("*"), F.count_if(F.col("n") > 1), F.sum("n")).first()
    pair, entity = F.xxhash64("entity", "term"), F.xxhash64("entity", F.lit(0).cast("long"))
    met = written(pairs.groupBy(pair.alias("pair"), "term").agg(F.count("*").alias("co")).select("pair", "co", "term"))
    co = KeySet.store(met.select("pair", "co"), met.count())
    terms = written(met.where("term <> 0").select("term").distinct())
    number = terms.count()
    copies = KeySet.store(texts.where("n > 1").groupBy("hash").agg(F.sum("n").alias("n")), repeated)
    df = document_frequencies(docs, text, copies, KeySet.store(terms, number))

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = lambda name: np.asarray(batch.column(name)).view(np.uint64)  # noqa: E731, B023
            both, named = co.values(key("pair"), 1), co.values(key("named"), 1)
            content = np.log2(total / named)
            mutual = content - np.log2(np.maximum(df.values(key("term"), 1), both) / both)
            share = np.divide(mutual, content, out=np.zeros(len(content)), where=content > 0)
            on = pa.array((content > 0) & (share >= disclosure))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("places"), pa.array(share)], names=["digest", "places", "share"]).filter(on)

    rows = pairs.where("term <> 0").select("digest", "places", "term", pair.alias("pair"), entity.alias("named"))
    places = rows.mapInArrow(rated, "digest string, places array<struct<start: long, end: long>>, share double").select("digest", F.explode("places").alias("p"), "share")
    one = places.groupBy("digest", F.col("p.start").alias("start"), F.col("p.end").alias("end")).agg(F.max("share").alias("share"))
    kind = F.when(F.col("share") >= removal, F.lit(5)).otherwise(F.lit(4)).cast("long")
    found = one.select("digest", F.struct("start", kind.alias("kind"), "end").alias("span")).groupBy("digest").agg(F.sort_array(F.collect_list("span")).alias("terms"))
    hot = (known or 0) / HOT
    return texts.select("digest", "n").join(found, "digest", "left").where(F.col("terms").isNotNull() | (F.col("n") > hot))


SPANS = "array<struct<start: long, kind: long, end: long>>"


def find_private(docs: DataFrame, text: str = "text", key: str = "doc_id", near: int = NEAR, disclosure: float = DISCLOSURE, removal: float = REMOVAL) -> DataFrame:
    """key, counts, base_sha256 and all spans of each row."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())]))
        for keys, digests, texts in slices(batches):
            failed: list[list[re.Match]] = [[] for _ in texts]
            every = [base_spans(t, f) for t, f in zip(texts, failed, strict=True)]
            count = [np.bincount([k for _, k, _ in s], minlength=4)[:4] if s else (0, 0, 0, 0) for s in every]
            sha = [hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in s).encode()).hexdigest() for s in every]
            spans = pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in s + inner_spans(f)] for s, f in zip(every, failed, strict=True)], kind)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(digests, pa.string()), *[pa.array([int(c[i]) for c in count], pa.int64()) for i in range(4)], pa.array(sha), spans], names=["key", "digest", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base"])

    source = docs.select(F.col(key).cast("long").alias("key"), digest(text).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = source.mapInArrow(found, f"key long, digest string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base {SPANS}")
    names = F.array(*map(F.lit, KINDS))
    spans = F.array_sort(F.concat("base", F.coalesce("terms", F.expr(f"cast(array() as {SPANS})"))))
    shown = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"].cast("int")], s["start"], s["end"])), ",")
    base = written(base)  # spans only, no texts
    return looked_up(base, revealing_terms(docs, text, near, disclosure, removal), "digest", docs.count(), 24 * F.size("terms")).select(F.col("key").alias(key), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", shown.alias("spans"))


def generalised(term: str) -> str:
    """A class that holds the term: numbers keep their first digit and length."""
    if term.isdecimal():
        return (term[0] if len(term) > 1 else "") + "x" * max(1, len(term) - 1)
    if any(c.isdecimal() for c in term):
        return "[code]"
    return "[name]" if term[0].isupper() else "[word]"


def sanitised(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced: by its kind, by its class for a generalised term, by nothing for a removed one. Overlapping spans are replaced together, by the first's kind."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], "" if kind == 5 else generalised(text[start:end]) if kind == 4 else f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, text: str = "text", near: int = NEAR, disclosure: float = DISCLOSURE, removal: float = REMOVAL) -> DataFrame:
    """The rows with sanitised texts, all other columns as they were."""
    names, at = docs.columns, docs.columns.index(text)
    own = free_name(names, "digest_of_text")
    shown = free_name([*names, own], "terms_of_text")
    terms = revealing_terms(docs, text, near, disclosure, removal).select(F.col("digest").alias(own), F.col("terms").alias(shown), "n")
    rows = looked_up(docs.withColumn(own, digest(text)), terms, own, docs.count(), 24 * F.size(shown)).select(*names, shown)

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for own, more in slices([batch.select([text, shown])]):
                texts += [t if t is None else sanitised(t, s) if (s := all_spans(t) + [(x["start"], x["kind"], x["end"]) for x in m or ()]) else t for t, m in zip(own, more, strict=True)]
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(changed, docs.schema)
