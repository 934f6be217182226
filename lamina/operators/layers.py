"""Raster layers with their opacity, details inside filled components, and recursive partition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import components as cc
from lamina.operators.background import dominant_colours
from lamina.operators.groups import in_whole_groups, least_connected, touching_runs
from lamina.operators.pixels import alpha, luma, squared_distance


def opaque_components(runs: DataFrame, distances: DataFrame, mask: DataFrame, low: float, high: float) -> DataFrame:
    """image_id, component_id, opaque (pixels with opacity), most: components that show at all."""
    shown = distances.join(mask.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi").withColumn("alpha", alpha(F.col("d2"), low, high))
    cells = cc.component_pixels(runs, shown.select("image_id", "y", "x", "alpha"))
    return cells.groupBy("image_id", "component_id").agg(F.count_if(F.col("alpha") > 0).alias("opaque"), F.max("alpha").alias("most")).where("most > 0")


def filled_components(runs: DataFrame, components: DataFrame, pixels: DataFrame, min_area: int, min_ratio: float, max_luma: float) -> DataFrame:
    """image_id, component_id, r, g, b of components that are large, nearly full and dark: their main colour."""
    full = components.where((F.col("area") >= min_area) & (F.col("area") / F.greatest(F.lit(1), F.col("width") * F.col("height")) >= min_ratio)).select("image_id", "component_id")
    cells = cc.component_pixels(runs.join(full, ["image_id", "component_id"], "left_semi"), pixels)
    return dominant_colours(cells, "image_id", "component_id").where(luma(F.col("r"), F.col("g"), F.col("b")) <= max_luma)


def detail_pixels(runs: DataFrame, filled: DataFrame, pixels: DataFrame, distance: float, min_detail: int) -> DataFrame:
    """image_id, component_id, y, x: pixels inside filled components that are far from their colour, where there are enough of them."""
    c = filled.select("image_id", "component_id", *[F.col(k).alias(f"c_{k}") for k in "rgb"])
    far = cc.component_pixels(runs.join(c.select("image_id", "component_id"), ["image_id", "component_id"], "left_semi"), pixels).join(c, ["image_id", "component_id"]).where(squared_distance(F.col("c_r"), F.col("c_g"), F.col("c_b")) >= distance * distance)
    enough = far.groupBy("image_id", "component_id").count().where(F.col("count") >= min_detail)
    return far.join(enough, ["image_id", "component_id"], "left_semi").select("image_id", "component_id", "y", "x")


def detail_spans(far: DataFrame) -> DataFrame:
    """Runs of detail_pixels() with label, the smallest run_id of what they touch within their component, whose neighbours may touch it."""
    keys = ["image_id", "component_id"]

    def label(rows: pa.Table) -> pa.Table:
        key = np.stack([rows.column(c).to_numpy() for c in keys], axis=1)
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).any(axis=1)]))
        y, s, e, run = (rows.column(c).to_numpy() for c in ("y", "x_start", "x_end", "run_id"))
        return rows.append_column("label", pa.array(run[least_connected(len(y), *touching_runs(group, y, s, e))].astype(np.int32)))

    spans = cc.runs(far, *keys)
    return in_whole_groups(spans, keys, ["y", "x_start"], label, ", ".join(f"{c} {t}" for c, t in spans.dtypes) + ", label int")


def details_of(spans: DataFrame, min_detail: int) -> DataFrame:
    """image_id, component_id, detail (from 1), label, area, x, y, width, height of details that are large enough."""
    found = cc.components(spans, "image_id", "component_id", "label").where(F.col("area") >= min_detail)
    order = Window.partitionBy("image_id", "component_id").orderBy(F.desc(F.col("width") * F.col("height")), F.desc("area"), "first_y", "first_x")
    return found.withColumn("detail", F.row_number().over(order)).select("image_id", "component_id", "detail", "label", "area", "x", "y", "width", "height")


def detail_components(runs: DataFrame, filled: DataFrame, pixels: DataFrame, distance: float, min_detail: int) -> DataFrame:
    """image_id, component_id, detail (from 1), area, x, y, width, height: marks inside filled components."""
    return details_of(detail_spans(detail_pixels(runs, filled, pixels, distance, min_detail)), min_detail).drop("label")


def sparse_gap(density: np.ndarray, threshold: float, least: int) -> tuple[int, int] | None:
    low = np.concatenate([[False], density <= threshold, [False]]).astype(int)
    start, end = np.flatnonzero(np.diff(low) == 1), np.flatnonzero(np.diff(low) == -1)
    size = end - start
    return (int(start[size.argmax()]), int(end[size.argmax()])) if len(size) and size.max() >= least else None


def cut(mask: np.ndarray, x: int, y: int, options: dict, depth: int = 0) -> list[tuple[np.ndarray, int, int]]:
    """Parts of a mask with their places, halved at the widest sparse gap again and again."""
    shape = mask.shape
    if depth >= options["depth"] or max(shape) < options["span"] or mask.sum() < options["area"]:
        return [(mask, x, y)]
    found = []
    for axis in (0, 1):
        size = shape[axis]
        gap = sparse_gap(mask.sum(axis=1 - axis) / max(1, shape[1 - axis]), options["density"], options["gap"]) if size >= options["span"] else None
        if gap and min((middle := sum(gap) // 2), size - middle) >= options["gap"]:
            found.append(((gap[1] - gap[0]) / size, axis, middle))
    if not found:
        return [(mask, x, y)]
    _, axis, at = max(found)
    first, second = np.split(mask, [at], axis)
    return cut(first, x, y, options, depth + 1) + cut(second, x + at * axis, y + at * (1 - axis), options, depth + 1)


def partition(runs: DataFrame, area: int = 800, density: float = 0.1, gap: int = 3, depth: int = 9, span: int = 140) -> DataFrame:
    """image_id, component_id, region (from 1), y, x_start, x_end: spans of large components, cut at sparse gaps. Components that are too small to be cut aren't sent to Python."""
    options = {"area": area, "density": density, "gap": gap, "depth": depth, "span": span}
    keys = ["image_id", "component_id"]
    spans = runs.select(*[F.col(c).cast("long").alias(c) for c in (*keys, "y", "x_start", "x_end")])
    large = cc.components(spans).where((F.greatest("width", "height") >= span) & (F.col("area") >= area)).select(*keys)

    def split(rows: pa.Table) -> pa.Table:
        image, component, y, a, b = (rows.column(c).to_numpy() for c in (*keys, "y", "x_start", "x_end"))
        edge = np.flatnonzero(np.concatenate([[True], (image[1:] != image[:-1]) | (component[1:] != component[:-1]), [True]]))
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] * 6]
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            left, top = int(a[i:j].min()), int(y[i])
            change = np.zeros((int(y[j - 1]) - top + 1, int(b[i:j].max()) - left + 2), np.int8)
            np.add.at(change, (y[i:j] - top, a[i:j] - left), 1)
            np.add.at(change, (y[i:j] - top, b[i:j] + 1 - left), -1)
            parts = [p for p in cut(change.cumsum(axis=1)[:, :-1] > 0, left, top, options) if p[0].any()]
            for region, (part, x0, y0) in enumerate(parts, 1):
                edges = np.diff(np.pad(part.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                (row, x_start), (_, x_end) = np.nonzero(edges == 1), np.nonzero(edges == -1)
                whole = lambda v: np.full(len(row), v)  # noqa: E731, B023
                out.append([whole(image[i]), whole(component[i]), whole(region), row + y0, x_start + x0, x_end + x0 - 1])
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=[*keys, "region", "y", "x_start", "x_end"])

    schema = "image_id long, component_id long, region long, y long, x_start long, x_end long"
    cut_ = in_whole_groups(spans.join(large, keys, "left_semi"), keys, ["y", "x_start"], split, schema)
    return cut_.unionByName(spans.join(large, keys, "left_anti").withColumn("region", F.lit(1).cast("long")))


def labelled_regions(runs: DataFrame) -> DataFrame:
    """Runs (image_id, component_id, region, y, x_start, x_end, run_id) with component_id anew, the smallest run_id that they touch within one old component and region."""
    keys = ["image_id", "component_id", "region"]

    def label(rows: pa.Table) -> pa.Table:
        key = np.stack([rows.column(c).to_numpy() for c in keys], axis=1)
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).any(axis=1)]))
        y, s, e, run = (rows.column(c).to_numpy() for c in ("y", "x_start", "x_end", "run_id"))
        least = least_connected(len(y), *touching_runs(group, y, s, e))
        return rows.select(["image_id", "y", "x_start", "x_end", "run_id"]).append_column("component_id", pa.array(run[least].astype(np.int32)))

    rows = runs.select(*keys, *[F.col(c).cast("int").alias(c) for c in ("y", "x_start", "x_end", "run_id")])
    return in_whole_groups(rows, keys, ["y", "x_start"], label, "image_id long, y int, x_start int, x_end int, run_id int, component_id int")


def laid_out(pixels: DataFrame, background: DataFrame, cells: DataFrame, n: int) -> DataFrame:
    """Pixels with render0, render1, ...: what each of n stacks of layers shows at their place (r, g, b), the background where no layer is. cells: with place, the number of their stack.

    Pixels and cells are dealt by image, in one shuffle; a place has one row for all stacks.
    """
    cell = F.struct("place", "z", "r", "g", "b", "alpha")
    own = pixels.select("image_id", "y", "x", F.struct("r", "g", "b").alias("own"), F.lit(None).alias("cell"))
    every = own.unionByName(cells.select("image_id", "y", "x", F.lit(None).alias("own"), cell.alias("cell"))).repartition("image_id")
    places = every.groupBy("image_id", "y", "x").agg(F.max("own").alias("own"), F.sort_array(F.collect_list("cell")).alias("stack")).where("own IS NOT NULL")
    ground = F.struct(*[F.col(f"bg_{c}").cast("double").alias(c) for c in "rgb"])
    over = lambda acc, s: F.struct(*[(acc[c] + (s[c] - acc[c]) * s["alpha"] / 255.0).alias(c) for c in "rgb"])
    shown = lambda acc: F.struct(*[F.bround(acc[c]).cast("int").alias(c) for c in "rgb"])
    own = lambda k: F.filter("stack", lambda s: s["place"] == k)
    renders = [F.aggregate(own(k), ground, over, shown).alias(f"render{k}") for k in range(n)]
    return places.join(background, "image_id").select("image_id", "y", "x", "own.*", *renders)


def composite(background: DataFrame, layers: DataFrame) -> DataFrame:
    """Pixels of the layers (image_id, z, y, x, r, g, b, alpha) laid over the background, lowest z first."""
    stack = F.sort_array(F.collect_list(F.struct("z", "r", "g", "b", "alpha")))
    over = lambda c: F.aggregate("stack", F.col(f"bg_{c}").cast("double"), lambda acc, s: acc + (s[c] - acc) * s["alpha"] / 255.0)
    stacked = layers.groupBy("image_id", "y", "x").agg(stack.alias("stack")).join(background, "image_id")
    return stacked.select("image_id", "y", "x", *[F.bround(over(c)).cast("int").alias(c) for c in "rgb"])
