"""Media columns: interleaved document sequences.

A media table holds payloads as images of 8-bit grey samples (PNG, made with the standard library), keyed by the
payload's SHA-256. Pages are HTML: parsing gives an ordered array of parts, each a text or a reference to media by
digest (`<img src="sha256:...">`), with the caption of the figure around it. References are resolved by a join on the
digest; positions and captions stay with them.

A null text or page counts as empty: no parts, or the payload of 64 zero bytes. Equal payloads have one digest, and
equal features. A reference without a media row keeps its place, with nulls. A part's position counts from 0. Rows are
independent, whatever their keys: repeated or null ones are pages of their own. Columns not asked for are not looked
at, those asked for are kept. Empty tables give empty ones. Pages and payloads may be of any length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import free_name, looked_up, slices

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
FEATURE = "kind string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def padded(data: bytes) -> bytes:
    """Zero bytes are appended up to a positive multiple of the width."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def encoded(payload: bytes, level: int = 1) -> bytes:
    """The payload as a grey PNG image of 64 columns."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each line
    lines[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def decoded(media: bytes) -> bytes:
    """The samples of an image made by encoded(); checksums are verified."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, size = 8, [], (0, 0)
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(media[at + 4 : at + 8 + n]):
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a filter that the encoder does not use")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean and spread of the samples, and a coarse histogram of 8 bins in thousandths."""
    v, value = np.frombuffer(payload, np.uint8), np.arange(256)
    count = sum(np.bincount(v[at : at + (1 << 20)], minlength=256) for at in range(0, len(v), 1 << 20))
    share = count.reshape(8, 32).sum(axis=1) * 1000 // len(v)
    total, square = int(count @ value), int(count @ value**2)
    mean = total / len(v)
    return f"{WIDTH}x{len(v) // WIDTH};mean={mean:.3f};sd={max(0.0, square / len(v) - mean * mean) ** 0.5:.3f};hist={'-'.join(map(str, share))}"


class Parts(HTMLParser):
    """Text and media references in the order of the page. A caption belongs to all images of its figure, before or after it."""

    SKIPPED = {"script", "style"}
    BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td", "th", "article", "section", "blockquote", "pre", "figure", "ul", "ol", "table", "br", "title", "nav"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[list] = []  # kind, text, digest, caption
        self.text: list[str] = []
        self.skip = 0
        self.inert: list[int] = []  # where open templates begin
        self.figure: list[int] | None = None
        self.said: str | None = None  # the caption of the open figure
        self.caption: list[str] | None = None

    def flush(self) -> None:
        if said := " ".join("".join(self.text).split()):
            self.out.append(["text", said, None, None])
        self.text = []

    def end_caption(self) -> None:
        """Takes up what was said since the caption began; outside a figure that is text."""
        if self.caption is not None:
            words, self.caption = " ".join("".join(self.caption).split()), None
            if self.figure is None:
                self.text = [words]
                self.flush()
            else:
                self.said = " ".join(filter(None, (self.said, words)))

    def end_figure(self) -> None:
        self.end_caption()
        if self.figure:
            for i in self.figure if self.said is not None else ():
                self.out[i][3] = self.said
        elif self.said:  # a caption of nothing
            self.out.append(["text", self.said, None, None])
        self.figure = self.said = None

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skip += 1
        elif tag == "template":
            self.flush()
            self.inert.append(len(self.out))
        elif tag == "img":
            self.flush()
            given = dict(attrs)
            source = given.get("src") or ""
            self.out.append(["media", None, source.removeprefix("sha256:") if source.startswith("sha256:") else None, given.get("alt")])
            if self.figure is not None:
                self.figure.append(len(self.out) - 1)
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag in self.BLOCKS:
            if self.caption is None:
                self.flush()
            else:
                self.caption.append(" ")
            if tag == "figure":
                self.end_figure()
                self.figure = []

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "template" and self.inert:
            self.text = []
            del self.out[self.inert.pop() :]
            if self.figure is not None:
                self.figure = [i for i in self.figure if i < len(self.out)]
        elif tag == "figcaption":
            self.end_caption()
        elif tag in self.BLOCKS:
            if self.caption is None or tag == "figure":
                self.flush()
            else:
                self.caption.append(" ")
            if tag == "figure":
                self.end_figure()

    def handle_data(self, data):
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)

    def ended(self) -> list[list]:
        """All parts. Of a figure that never ends, the words since its caption began are text."""
        if self.caption is not None and self.figure is not None:
            words, self.caption = self.caption, None
            self.end_figure()
            self.text = words
        self.end_caption()
        self.end_figure()
        self.flush()
        return self.out


def parsed(html: str) -> list[list]:
    p = Parts()
    p.feed(html)
    p.close()
    return p.ended()


PART = [("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]


def parse_pages(pages: DataFrame, html: str, *keep: str) -> DataFrame:
    """The columns named in keep, and parts: an array of structs of position, kind (text or media), text, digest and caption, in order. A row for each page."""
    shown = free_name(list(keep), "html")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for (some,) in slices([batch.select([shown])], 200, 8 << 20):
                found = [[dict(zip([n for n, _ in PART], (k, *part), strict=True)) for k, part in enumerate(parsed(page or ""))] for page in some]
                own = batch.slice(done, len(some)).select(list(keep))
                done += len(some)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found, pa.list_(pa.struct(PART)))], names=[*keep, "parts"])

    rows = pages.select(*keep, F.col(html).alias(shown))
    kinds = "".join(f"`{c}` {t}, " for c, t in rows.select(*keep).dtypes)
    return rows.mapInArrow(parts, f"{kinds}parts array<struct<position: int, kind: string, text: string, digest: string, caption: string>>")


def media_table(payloads: DataFrame, key: str, column: str) -> DataFrame:
    """key, digest and media (PNG bytes) of each row's payload (binary or text; null: empty)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, data in slices(batches, 500):
            whole = [padded(x) for x in data]
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "n_bytes": pa.array(map(len, data), pa.int64()), "digest": [hashlib.sha256(x).hexdigest() for x in whole], "media": pa.array(map(encoded, whole), pa.binary())})

    rows = payloads.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias("data"))
    return rows.mapInArrow(made, "key long, n_bytes long, digest string, media binary").withColumnRenamed("key", key)


def read_media(media: DataFrame, *keep: str) -> DataFrame:
    """The columns named in keep, and what the stored bytes hold when read back."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for (blobs,) in slices([batch.select(["media"])], 500):
                for blob in blobs:
                    payload = decoded(blob)
                    rows.append(("image/png", len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(payload)))
            found = [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])]
            yield pa.RecordBatch.from_arrays([*batch.select(list(keep)).columns, *found], names=[*keep, *[x.split()[0] for x in FEATURE.split(", ")]])

    kinds = [f"`{c}` {t}" for c, t in media.dtypes if c in keep]
    return media.select(*keep, "media").mapInArrow(back, ", ".join([*kinds, FEATURE]))


def resolve(references: DataFrame, media: DataFrame) -> DataFrame:
    """References (with a column digest) with a struct media: what the payload of their digest holds, or null.

    media: rows of read_media(). The bytes stay where they are, the join moves small rows; a digest that very many refer to is looked up apart.
    """
    features = [x.split()[0] for x in FEATURE.split(", ") if not x.startswith("kind")]
    m = media.select(F.col("payload_sha256").alias("digest"), F.struct(*features).alias("media")).groupBy("digest").agg(F.first("media").alias("media"))
    asked = references.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"))
    return looked_up(references, asked.join(m, "digest", "left"), "digest")


def interleave(pages: DataFrame, media: DataFrame) -> DataFrame:
    """Rows of parse_pages(), each media part with the features of its payload (null: none is stored).

    Pages that refer to the same digests in the same order get the same features, so that only lists of digests are looked up.
    """
    names = pages.columns
    refs, found = free_name(names, "refs"), free_name(names, "found")
    digests = F.transform(F.filter("parts", lambda p: p["digest"].isNotNull()), lambda p: p["digest"])
    rows = pages.withColumn(refs, F.sha2(F.array_join(digests, ","), 256))
    lists = rows.groupBy(F.col(refs).alias("list")).agg(F.count("*").alias("n"), F.first(F.array_distinct(digests)).alias("digests"))
    each = resolve(lists.select("list", F.explode("digests").alias("digest")), media).where("media is not null")
    maps = each.groupBy("list").agg(F.map_from_entries(F.collect_list(F.struct("digest", "media"))).alias(found))
    met = looked_up(rows, lists.select("list", "n").join(maps, "list", "left").withColumnRenamed("list", refs), refs, size=512 * F.coalesce(F.size(found), F.lit(0)))
    whole = F.transform("parts", lambda p: F.struct(*[p[n].alias(n) for n, _ in PART], F.when(p["digest"].isNotNull(), F.col(found)[p["digest"]]).alias("media")))
    return met.withColumn("parts", whole).select(*names)


def payload_digest(column: str):
    """Digest of the padded payload, as an expression."""
    data = F.coalesce(F.col(column).cast("binary"), F.lit(b""))
    size = F.octet_length(data)
    pad = F.when(size == 0, F.lit(WIDTH)).otherwise(F.pmod(-size, F.lit(WIDTH)))
    return F.sha2(F.concat(data, F.substring(F.lit(bytes(WIDTH)), F.lit(1), pad)), 256)
