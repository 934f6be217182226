"""Images as strips of rows: a row for each strip, with its pixels as bytes, worked on in NumPy.

A strip (image_id, strip, width, height, data) has so many rows of an image, from row strip * rows on, as bytes r, g, b;
the last one may have fewer. A step that looks at neighbours gets a halo: the rows next to a strip's edges, taken from
the strips above and below. No step holds a whole image, and what is shuffled are strips, colours and runs, never pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.model import SegmentOptions
from lamina.operators import background as bg
from lamina.operators import components as cc
from lamina.operators.groups import in_whole_groups
from lamina.operators.pixels import squared_distance
from lamina.sources.tables import written

#: Rows of a strip.
ROWS = 256
#: Pixels that are counted at once.
PIXELS = 1 << 19
STRIP = "image_id long, strip int, width int, height int, data binary"


def strips_of(images: DataFrame, rows: int = ROWS) -> DataFrame:
    """Strips of images as files.read_images() gives them (bytes b, g, r, and opacity, or grey)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                image, width, height, channels = (batch.column(c)[i].as_py() for c in ("image_id", "width", "height", "channels"))
                px = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8).reshape(height, width, channels)
                px = px[:, :, [2, 1, 0]] if channels > 1 else np.repeat(px, 3, axis=2)
                for strip in range(-(-height // rows)):
                    data = np.ascontiguousarray(px[strip * rows : (strip + 1) * rows]).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([image], pa.int64()), *[pa.array([v], pa.int32()) for v in (strip, width, height)], pa.array([data], pa.binary())], names=["image_id", "strip", "width", "height", "data"])

    return images.select("image_id", "width", "height", "channels", "data").mapInArrow(cut, STRIP)


def strips_of_pixels(pixels: DataFrame, width: int, height: int, rows: int = ROWS) -> DataFrame:
    """Strips of images of one size, of their pixels."""

    def gathered(cells: pa.Table) -> pa.Table:
        image, strip = cells.column("image_id").to_numpy(), cells.column("strip").to_numpy()
        rgb = np.stack([cells.column(c).to_numpy() for c in "rgb"], axis=1).astype(np.uint8)
        edge = np.flatnonzero(np.concatenate([[True], (image[1:] != image[:-1]) | (strip[1:] != strip[:-1]), [True]]))
        first, n = edge[:-1], len(edge) - 1
        data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((edge * 3).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rgb))])
        return pa.table([pa.array(image[first]), pa.array(strip[first]), *[pa.array(np.full(n, v, np.int32)) for v in (width, height)], data], names=["image_id", "strip", "width", "height", "data"])

    own = pixels.select(F.col("image_id").cast("long"), F.floor(F.col("y") / rows).cast("int").alias("strip"), "y", "x", "r", "g", "b")
    return in_whole_groups(own, ["image_id", "strip"], ["y", "x"], gathered, STRIP, deal=2)


def picture(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(-1, row["width"], 3)


def all_pixels(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The pixels of all strips of a batch one after the other, and how many each strip has."""
    data = batch.column("data")
    ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    values = np.frombuffer(data.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return values.reshape(-1, 3), np.diff(ends).astype(np.int64) // 3


def bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of strips next to each other, of PIXELS pixels or a strip."""
    size = all_pixels(batch)[1]
    first = 0
    while first < len(size):
        n = max(1, int(np.searchsorted(np.cumsum(size[first:]), PIXELS, "right")))
        yield batch.slice(first, n)
        first += n


def colour_counts(strips: DataFrame, rows: int = ROWS) -> DataFrame:
    """As background.colour_counts(), of strips: each counts its own colours before they meet."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in bounded(batch):
                yield counts_of(some)

    def counts_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        image, strip, width, height = (batch.column(c).to_numpy().astype(np.int64) for c in ("image_id", "strip", "width", "height"))
        px, size = all_pixels(batch)
        own = np.repeat(np.arange(len(size)), size)
        y, x = np.divmod(np.arange(len(px)) - np.repeat(np.cumsum(size) - size, size), width[own])
        y += (strip * rows)[own]
        least = np.minimum(width, height)
        at = lambda v, near, n: (v < near[own]).astype(np.int64) + (v >= (n - near)[own])
        band, side = np.maximum(2, least // 18), np.maximum(8, least // 24)
        border, corner = at(y, band, height) + at(x, band, width), at(y, side, height) * at(x, side, width)
        colour, place, n = np.unique(own << 24 | px[:, 0].astype(np.int64) << 16 | px[:, 1].astype(np.int64) << 8 | px[:, 2], return_inverse=True, return_counts=True)
        sums = [n, *[np.bincount(place.reshape(-1), w, len(colour)).astype(np.int64) for w in (border, corner)]]
        return pa.RecordBatch.from_arrays([pa.array(image[colour >> 24]), *[pa.array((colour >> s & 255).astype(np.int32)) for s in (16, 8, 0)], *map(pa.array, sums)], names=["image_id", "r", "g", "b", "n", "border", "corner"])

    found = strips.mapInArrow(counted, "image_id long, r int, g int, b int, n long, border long, corner long")
    return found.groupBy("image_id", "r", "g", "b").agg(*[F.sum(c).alias(c) for c in ("n", "border", "corner")])


def grown(mask: np.ndarray, radius: int) -> np.ndarray:
    """The mask grown by a square of the radius."""
    for axis in (0, 1):
        if radius and mask.size:
            pad = [(radius, radius) if a == axis else (0, 0) for a in (0, 1)]
            mask = np.lib.stride_tricks.sliding_window_view(np.pad(mask, pad), 2 * radius + 1, axis).any(axis=-1)
    return mask


def with_halo(strips: DataFrame, halo: int, rows: int) -> DataFrame:
    """Strips with part 0, and for each strip above and below the rows that these need, with part 1 and -1."""
    if halo > rows:
        raise ValueError("a halo must not be higher than a strip")
    line = F.col("width") * 3
    near = F.least(F.lit(halo), (F.octet_length("data") / line).cast("int")) * line
    last = F.ceil(F.col("height") / rows) - 1
    own = F.struct(F.col("strip").alias("strip"), F.lit(0).alias("part"), F.col("data").alias("data"))
    up = F.when(F.col("strip") > 0, F.struct((F.col("strip") - 1).alias("strip"), F.lit(1).alias("part"), F.substring("data", F.lit(1), near).alias("data")))
    down = F.when(F.col("strip") < last, F.struct((F.col("strip") + 1).alias("strip"), F.lit(-1).alias("part"), F.substring("data", (F.octet_length("data") - near + 1).cast("int"), near).alias("data")))
    each = F.explode(F.array_compact(F.array(own, up, down) if halo else F.array(own)))
    return strips.select("*", each.alias("e")).select("image_id", "e.strip", "e.part", "width", "height", "e.data", *[c for c in strips.columns if c not in ("image_id", "strip", "width", "height", "data")])


def runs(strips: DataFrame, background: DataFrame, options: SegmentOptions, rows: int = ROWS) -> DataFrame:
    """image_id, y, x_start, x_end, visible: spans of the grown mask, and whether an opaque pixel is in them."""
    kinds = "image_id long, y int, x_start int, x_end int, visible boolean"
    threshold, radius, low, high = options.bg_threshold, options.dilation_px, options.alpha_low, options.alpha_high

    def found(table: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] * 4 + [np.empty(0, bool)]]
        group: list[dict] = []
        key = None
        for row in [*table.to_pylist(), None]:
            if row is None or (row["image_id"], row["strip"]) != key:
                if group:
                    out.append(spans(group))
                group, key = [], row and (row["image_id"], row["strip"])
            group.append(row)
        return pa.table([pa.array(np.concatenate(c)).cast(t) for c, t in zip(zip(*out, strict=True), [pa.int64(), *[pa.int32()] * 3, pa.bool_()], strict=True)], names=["image_id", "y", "x_start", "x_end", "visible"])

    def spans(parts: list[dict]) -> list[np.ndarray]:
        own = next(p for p in parts if not p["part"])
        above = sum(len(picture(p)) for p in parts if p["part"] < 0)
        px = np.concatenate([picture(p) for p in sorted(parts, key=lambda p: p["part"])]).astype(np.int32)
        d2 = ((px - np.array([own["bg_r"], own["bg_g"], own["bg_b"]], np.int32)) ** 2).sum(axis=2)
        mask = d2 > threshold * threshold
        here = slice(above, above + len(picture(own)))
        opaque = mask[here] & (np.floor(np.clip((np.sqrt(d2[here]) - low) / max(1, high - low) * 255, 0, 255)) > 0)
        edges = np.diff(np.pad(grown(mask, radius)[here].astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (y, start), (_, end) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        before = np.pad(opaque.cumsum(axis=1), ((0, 0), (1, 0)))
        return [np.full(len(y), own["image_id"]), y + own["strip"] * rows, start, end - 1, before[y, end] > before[y, start]]

    own = with_halo(strips.join(background, "image_id"), radius, rows)
    return in_whole_groups(own, ["image_id", "strip"], ["part"], found, kinds, deal=2)


def layers(strips: DataFrame, width: int, height: int, options: SegmentOptions, rows: int = ROWS) -> DataFrame:
    """image_id, layer_id, area, x, y, width, height, z of images of one size: what engine.extract_layers() gives by options without partition, details and surface.

    What several steps read is written to the shared folder: strips, counts of colours and runs, each made once.
    """
    strips = written(strips)
    counts = written(colour_counts(strips, rows))
    spans = cc.numbered(written(runs(strips, bg.background_of(counts), options, rows)), rows)
    labelled = cc.labelled_strips(spans, rows)
    seen = labelled.groupBy("image_id", "component_id").agg(F.max("visible").alias("visible")).where("visible")
    found = cc.largest(cc.components(labelled), options.min_area_px, options.min_bbox_px, options.max_layers)
    return cc.layers(found.join(seen, ["image_id", "component_id"], "left_semi"), options.crop_padding_px, width, height)


def foreground_pixels(counts: DataFrame, background: DataFrame, threshold: float) -> DataFrame:
    """image_id, foreground_pixels: from the counts of colours alone."""
    near = counts.join(background, "image_id")
    return near.where(squared_distance(F.col("bg_r"), F.col("bg_g"), F.col("bg_b")) > threshold * threshold).groupBy("image_id").agg(F.sum("n").alias("foreground_pixels"))
