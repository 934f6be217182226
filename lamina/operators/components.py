"""Runs, connected components, and what is made of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.groups import grown_spans, in_whole_groups, least_connected, touching_runs
from lamina.operators.pixels import padded
from lamina.sources.tables import written


def runs(mask: DataFrame, *keys: str) -> DataFrame:
    """keys, y, x_start, x_end (inclusive), run_id (from 1, in raster order): maximal spans of set pixels."""
    keys = keys or ("image_id",)
    island = F.col("x") - F.row_number().over(Window.partitionBy(*keys, "y").orderBy("x"))
    spans = mask.withColumn("island", island).groupBy(*keys, "y", "island").agg(F.min("x").alias("x_start"), F.max("x").alias("x_end")).drop("island")
    return spans.withColumn("run_id", F.row_number().over(Window.partitionBy(*keys).orderBy("y", "x_start")))


def numbered(spans: DataFrame, rows: int) -> DataFrame:
    """Spans (image_id, y, x_start, x_end) with strip (of so many rows) and run_id, as runs() numbers them. Only counts of strips meet by image."""
    own = ["image_id", "strip"]
    spans = spans.withColumn("strip", F.floor(F.col("y") / rows).cast("int"))
    before = Window.partitionBy("image_id").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    first = spans.groupBy(*own).agg(F.count("*").alias("n")).select(*own, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = spans.withColumn("nth", F.row_number().over(Window.partitionBy(*own).orderBy("y", "x_start")))
    return placed.join(first, own).withColumn("run_id", (F.col("before") + F.col("nth")).cast("int")).drop("before", "nth")


def labelled_strips(spans: DataFrame, rows: int) -> DataFrame:
    """Runs of numbered() with component_id, as labelled() gives it, without an image in one task.

    Strips are labelled apart. Where runs of two strips touch, their labels are linked, and what meets by image is only
    this graph of the strips' components at seams.
    """
    own = ["image_id", "strip"]

    def label(rows_: pa.Table) -> pa.Table:
        image, strip, y, s, e, run = (rows_.column(c).to_numpy() for c in (*own, "y", "x_start", "x_end", "run_id"))
        group = np.cumsum(np.concatenate([[0], (image[1:] != image[:-1]) | (strip[1:] != strip[:-1])]))
        return rows_.append_column("label", pa.array(run[least_connected(len(y), *touching_runs(group, y, s, e))].astype(np.int32)))

    kinds = ", ".join(f"{c} {t}" for c, t in spans.dtypes)
    local = written(in_whole_groups(spans, own, ["y", "x_start"], label, f"{kinds}, label int", deal=2))
    above = local.where(F.col("y") % rows == rows - 1).select("image_id", (F.col("y") + 1).alias("y"), F.col("label").alias("a"), F.col("x_start").alias("s"), F.col("x_end").alias("e"))
    below = local.where(F.col("y") % rows == 0).select("image_id", "y", F.col("label").alias("b"), "x_start", "x_end")
    seams = above.join(below, ["image_id", "y"]).where((F.col("x_start") <= F.col("e") + 1) & (F.col("x_end") >= F.col("s") - 1)).select("image_id", "a", "b").distinct()

    def merged(links: pa.Table) -> pa.Table:
        image, a, b = (links.column(c).to_numpy() for c in ("image_id", "a", "b"))
        group = np.cumsum(np.concatenate([[0], image[1:] != image[:-1]]))
        node, place = np.unique(np.stack([np.tile(group, 2), np.concatenate([a, b])]), axis=1, return_inverse=True)
        place = place.reshape(-1)
        least = least_connected(node.shape[1], place[: len(a)], place[len(a) :])
        return pa.table({"image_id": pa.array(image[np.searchsorted(group, node[0])]), "label": pa.array(node[1].astype(np.int32)), "whole": pa.array(node[1][least].astype(np.int32))})

    whole = in_whole_groups(seams, ["image_id"], ["a", "b"], merged, "image_id long, label int, whole int")
    return local.join(whole, ["image_id", "label"], "left").withColumn("component_id", F.coalesce("whole", "label")).drop("whole", "label")


def run_edges(spans: DataFrame) -> DataFrame:
    """image_id, a, b: runs of neighbouring rows that touch, diagonally too. The join's key holds image and row."""
    a = spans.select("image_id", (F.col("y") - 1).alias("y"), F.col("run_id").alias("a"), F.col("x_start").alias("s"), F.col("x_end").alias("e"))
    b = spans.select("image_id", "y", F.col("run_id").alias("b"), "x_start", "x_end")
    return a.join(b, ["image_id", "y"]).where((F.col("x_start") <= F.col("e") + 1) & (F.col("x_end") >= F.col("s") - 1)).select("image_id", "a", "b")


def labelled(spans: DataFrame) -> DataFrame:
    """Runs with component_id, the smallest run_id of their component. Images are labelled many at once; one image is in one task."""

    def label(rows: pa.Table) -> pa.Table:
        image, y, s, e, run = (rows.column(c).to_numpy() for c in ("image_id", "y", "x_start", "x_end", "run_id"))
        least = least_connected(len(y), *touching_runs(image, y, s, e))
        return rows.append_column("component_id", pa.array(run[least].astype(np.int32)))

    kinds = ", ".join(f"{c} {t}" for c, t in spans.dtypes)
    return in_whole_groups(spans, ["image_id"], ["y", "x_start"], label, f"{kinds}, component_id int")


def places_of(rows: pa.Table, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pixels of whole images: the images, each pixel's among them, and its place as groups.grown_spans() has it."""
    image, y, x = (rows.column(c).to_numpy().astype(np.int64) for c in ("image_id", "y", "x"))
    new = np.concatenate([[True], image[1:] != image[:-1]])
    group = np.cumsum(new) - 1
    return image[new], group, (group * height + y) * (width + 2) + x


def labelled_cases(distances: DataFrame, masks: list[tuple[float, int]], width: int, height: int) -> DataFrame:
    """As labelled() gives them, the runs of several masks of each image: of pixels farther than a threshold, grown by a radius. The image_id is n times the image's, plus the mask's place; pixels are shuffled once for all masks."""

    def label(rows: pa.Table) -> pa.Table:
        images, _, places = places_of(rows, width, height)
        d2 = rows.column("d2").to_numpy()
        out = []
        for k, (threshold, radius) in enumerate(masks):
            start, end = grown_spans(places[d2 > threshold * threshold], radius, width, height)
            row = start // (width + 2)
            group, y, s, e = row // height, row % height, start - row * (width + 2), end - row * (width + 2)
            run = np.arange(1, len(row) + 1) - np.searchsorted(group, group)
            out.append([images[group] * len(masks) + k, y, s, e, run, run[least_connected(len(y), *touching_runs(group, y, s, e))]])
        return pa.table([pa.array(np.concatenate(c)).cast(pa.int32() if i else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=["image_id", "y", "x_start", "x_end", "run_id", "component_id"])

    least = min(t for t, _ in masks)
    rows = distances.where(F.col("d2") > least * least).select("image_id", "y", "x", "d2")
    return in_whole_groups(rows, ["image_id"], [], label, "image_id long, y int, x_start int, x_end int, run_id int, component_id int")


def surface_cases(distances: DataFrame, masks: list[tuple[float, int, float] | None], width: int, height: int, least: int) -> DataFrame:
    """image_id (as of labelled_cases()), y, x, r, g, b: for each mask (threshold, radius, low threshold) the pixels over the low threshold that the grown mask doesn't hold; none where they are fewer than the least number."""

    def left(rows: pa.Table) -> pa.Table:
        images, group, places = places_of(rows, width, height)
        d2 = rows.column("d2").to_numpy()
        out = []
        for k, mask in enumerate(masks):
            if mask:
                threshold, radius, low = mask
                start, end = grown_spans(places[d2 > threshold * threshold], radius, width, height)
                covered = np.append(end, -1)[np.searchsorted(start, places, "right") - 1] >= places
                free = (d2 > low * low) & ~covered
                some = rows.filter(pa.array(free & (np.bincount(group[free], minlength=len(images)) >= least)[group]))
                out.append(some.set_column(0, "image_id", pa.array(some.column("image_id").to_numpy().astype(np.int64) * len(masks) + k)).drop_columns("d2"))
        return pa.concat_tables(out)

    lowest = min(m[2] for m in masks if m)
    kinds = {"image_id": "long"} | dict.fromkeys(("y", "x", "r", "g", "b", "d2"), "int")
    rows = distances.where(F.col("d2") > lowest * lowest).select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])
    return in_whole_groups(rows, ["image_id"], [], left, "image_id long, y int, x int, r int, g int, b int")


def components(runs_: DataFrame, *keys: str) -> DataFrame:
    """keys, area, x, y, width, height, first_y, first_x. keys: of a component; default image_id, component_id."""
    keys = keys or ("image_id", "component_id")
    first = F.min(F.struct("y", "x_start"))
    c = runs_.groupBy(*keys).agg(F.sum(F.col("x_end") - F.col("x_start") + 1).alias("area"), F.min("x_start").alias("x"), F.min("y").alias("y"), F.max("x_end").alias("right"), F.max("y").alias("bottom"), first.alias("first"))
    return c.select(*keys, "area", "x", "y", (F.col("right") - F.col("x") + 1).alias("width"), (F.col("bottom") - F.col("y") + 1).alias("height"), F.col("first.y").alias("first_y"), F.col("first.x_start").alias("first_x"))


def largest(c: DataFrame, min_area: int | Column, min_side: int | Column, max_layers: int | Column) -> DataFrame:
    """Components that are large enough, the max_layers largest of an image, with their rank."""
    kept = c.where((F.col("area") >= min_area) & (F.col("width") >= min_side) & (F.col("height") >= min_side))
    order = Window.partitionBy("image_id").orderBy(F.desc(F.col("width") * F.col("height")), F.desc("area"), "first_y", "first_x")
    return kept.withColumn("index", F.row_number().over(order)).where(F.col("index") <= max_layers)


def layers(c: DataFrame, padding: int, width: int, height: int) -> DataFrame:
    """image_id, layer_id, area, x, y, width, height (padded) and z (1: at the bottom) of ranked components."""
    box = padded({k: F.col(k) for k in ("x", "y", "width", "height")}, padding, F.lit(width), F.lit(height))
    out = c.select("image_id", F.format_string("raster_%03d", "index").alias("layer_id"), "area", *[v.alias(k) for k, v in box.items()])
    order = Window.partitionBy("image_id").orderBy(F.desc(F.col("width") * F.col("height")), F.desc("y"), F.desc("x"), "layer_id")
    return out.withColumn("z", F.row_number().over(order))


def component_pixels(runs_: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels of each component: its spans are spread out and joined by place."""
    cells = runs_.select("image_id", "component_id", "y", F.explode(F.sequence("x_start", "x_end")).alias("x"))
    return cells.join(pixels, ["image_id", "y", "x"])


def densities(mask: DataFrame, axis: str, length: int, across: int) -> DataFrame:
    """image_id, pos, density: share of set pixels in each row (axis y) or column (axis x), empty ones too."""
    every = mask.select("image_id").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    counts = mask.groupBy("image_id", F.col(axis).alias("pos")).agg(F.count("*").alias("n"))
    return every.join(counts, ["image_id", "pos"], "left").select("image_id", "pos", (F.coalesce("n", F.lit(0)) / max(1, across)).alias("density"))


def longest_sparse_run(density: DataFrame, threshold: float, min_gap: int) -> DataFrame:
    """image_id, start, end (exclusive): the longest stretch at or under the threshold, ties to the first."""
    sparse = density.where(F.col("density") <= threshold)
    island = F.col("pos") - F.row_number().over(Window.partitionBy("image_id").orderBy("pos"))
    spans = sparse.withColumn("island", island).groupBy("image_id", "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).where(F.col("end") - F.col("start") >= min_gap)
    return spans.groupBy("image_id").agg(F.max_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("s")).select("image_id", "s.start", "s.end")


def best_sparse_split(mask: DataFrame, width: int, height: int, threshold: float, min_gap: int, min_span: int) -> DataFrame:
    """image_id, share, axis (1: a vertical cut), pos: where an image's mask is best cut in two."""
    parts = []
    for axis, number, length, across in (("x", 1, width, height), ("y", 0, height, width)):
        if length >= min_span:
            gap = longest_sparse_run(densities(mask, axis, length, across), threshold, min_gap)
            middle = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
            parts.append(gap.select("image_id", ((F.col("end") - F.col("start")) / length).alias("share"), F.lit(number).alias("axis"), middle.alias("pos")).where((F.col("pos") >= min_gap) & (length - F.col("pos") >= min_gap)))
    found = parts[0].unionAll(parts[1]) if len(parts) == 2 else parts[0]
    return found.groupBy("image_id").agg(F.max(F.struct("share", "axis", "pos")).alias("s")).select("image_id", "s.*")
