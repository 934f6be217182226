"""Pixel maths, masks and neighbourhoods. Pixels: image_id, y, x, r, g, b. A mask holds the pixels that are set."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL = ["image_id", "y", "x"]


def squared_distance(r: Column, g: Column, b: Column) -> Column:
    """Squared distance of a pixel to a colour; comparing it with a squared threshold needs no root."""
    return (F.col("r") - r) * (F.col("r") - r) + (F.col("g") - g) * (F.col("g") - g) + (F.col("b") - b) * (F.col("b") - b)


def with_distance(pixels: DataFrame, background: DataFrame) -> DataFrame:
    """Pixels with d2, the squared distance to their image's background (image_id, bg_r, bg_g, bg_b)."""
    return pixels.join(background, "image_id").withColumn("d2", squared_distance(F.col("bg_r"), F.col("bg_g"), F.col("bg_b"))).drop("bg_r", "bg_g", "bg_b")


def foreground(distances: DataFrame, threshold: float, text_boxes: DataFrame | None = None) -> DataFrame:
    """Pixels farther than the threshold from the background and outside all text boxes."""
    mask = distances.where(F.col("d2") > threshold * threshold)
    if text_boxes is not None:
        mask = mask.join(text_mask(mask, text_boxes), PIXEL, "left_anti")
    return mask


def text_mask(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels inside a box (image_id, left, top, right, bottom; ends exclusive). Boxes meet the pixels of their own image only."""
    b = boxes.select(F.col("image_id").alias("of"), "left", "top", "right", "bottom")
    inside = (F.col("image_id") == F.col("of")) & (F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom"))
    return pixels.join(b, inside, "left_semi").select(*PIXEL)


def alpha(d2: Column, low: float | Column, high: float | Column) -> Column:
    """Opacity of a distance: a ramp from low to high, clipped and truncated."""
    span = F.greatest(F.lit(1), high - low) if isinstance(high, Column) else max(1, high - low)
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.sqrt(d2) - low) / span * 255))).cast("int")


def packed(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def quantised(r: Column, g: Column, b: Column) -> Column:
    """The 24-bit colour in the middle of a cell of 16 levels a channel."""
    q = lambda c: (F.floor(c / 16) * 16 + 8).cast("int")
    return packed(q(r), q(g), q(b))


def unpacked(colour: Column) -> tuple[Column, Column, Column]:
    low = F.lit(255)
    return F.shiftright(colour, 16).bitwiseAND(low), F.shiftright(colour, 8).bitwiseAND(low), colour.bitwiseAND(low)


def luma(r: Column, g: Column, b: Column) -> Column:
    return (r * 0.2126 + g * 0.7152 + b * 0.0722) / 255.0


def saturation(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def padded(box: dict[str, Column], pad: int, width: Column, height: Column) -> dict[str, Column]:
    """x, y, width, height of a box grown on all sides and cut at the image's edges."""
    left, top = F.greatest(F.lit(0), box["x"] - pad), F.greatest(F.lit(0), box["y"] - pad)
    right, bottom = F.least(width, box["x"] + box["width"] + pad), F.least(height, box["y"] + box["height"] + pad)
    return {"x": left, "y": top, "width": right - left, "height": bottom - top}


def dilated(mask: DataFrame, radius: int | Column, width: int, height: int) -> DataFrame:
    """The mask grown by a square of the radius, within the image: along its rows, then its columns. The radius may be a column of the mask that is the same for all pixels of an image."""
    if not isinstance(radius, Column) and radius <= 0:
        return mask.select(*PIXEL)
    own = mask.select(*PIXEL, (radius if isinstance(radius, Column) else F.lit(radius)).cast("int").alias("radius"))
    around = lambda c: F.explode(F.sequence(F.col(c) - F.col("radius"), F.col(c) + F.col("radius"))).alias(c)
    wide = own.select("image_id", "y", "radius", around("x")).where(F.col("x").between(0, width - 1)).distinct()
    return wide.select("image_id", around("y"), "x").where(F.col("y").between(0, height - 1)).distinct()


def closed(mask: DataFrame, width: int, height: int) -> DataFrame:
    """Dilation, then erosion, by 3 x 3: a pixel stays if all of its neighbours inside the image are set after dilation."""
    grown = dilated(mask, 1, width, height)
    around = F.sequence(F.lit(-1), F.lit(1))
    votes = grown.select("image_id", F.explode(F.transform(around, lambda d: F.col("y") + d)).alias("y"), "x").select("image_id", "y", F.explode(F.transform(around, lambda d: F.col("x") + d)).alias("x"))
    votes = votes.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).groupBy(*PIXEL).agg(F.count("*").alias("n"))
    side = lambda c, n: F.lit(3) - (F.col(c) == 0).cast("int") - (F.col(c) == n - 1).cast("int")
    return votes.where(F.col("n") == side("y", height) * side("x", width)).select(*PIXEL)


def block_average(pixels: DataFrame, factor: int) -> DataFrame:
    """Means of factor x factor pixels, rounded half to even."""
    cell = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("y", "x")]
    return pixels.select("image_id", *cell, "r", "g", "b").groupBy(*PIXEL).agg(*[F.bround(F.avg(c)).cast("int").alias(c) for c in "rgb"])


#: Lobes of the window, and bits of a weight's fraction.
LOBES, BITS = 3, 22


def sinc(x: float) -> float:
    return math.sin(math.pi * x) / (math.pi * x) if x else 1.0


def resampling_weights(size: int, to: int) -> list[tuple[int, int, int]]:
    """(place, source, weight): what each of so many places takes from each of size places, as whole numbers of 2 ** -BITS.

    A windowed sinc, as wide as the step between places if that is over 1, whose weights add up to 1 at the edges too.
    """
    step = size / to
    wide = max(1.0, step)
    out = []
    for place in range(to):
        centre = (place + 0.5) * step
        sources = range(max(0, int(centre - LOBES * wide + 0.5)), min(size, int(centre + LOBES * wide + 0.5)))
        far = [(s - centre + 0.5) / wide for s in sources]
        weights = [sinc(x) * sinc(x / LOBES) if -LOBES <= x < LOBES else 0.0 for x in far]
        total = sum(weights)
        out += [(place, s, math.floor(abs(w / total) * (1 << BITS) + 0.5) * (1 if w >= 0 else -1)) for s, w in zip(sources, weights, strict=True)]
    return out


def resized(pixels: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Images of one size as images of another, along rows, then columns. The tables of weights have a few rows for each column and row of the larger size."""
    spark = pixels.sparkSession

    def along(px: DataFrame, axis: str, other: str, size: int, to: int) -> DataFrame:
        if size == to:
            return px
        weights = spark.createDataFrame(resampling_weights(size, to), f"place int, {axis} int, weight long")
        met = px.join(F.broadcast(weights), axis).groupBy("image_id", other, F.col("place").alias(axis))
        value = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), F.shiftright(F.sum(F.col(c) * F.col("weight")) + (1 << BITS - 1), BITS))).cast("int").alias(c)
        return met.agg(*map(value, "rgb"))

    return along(along(pixels.select(*PIXEL, "r", "g", "b"), "x", "y", width, to_width), "y", "x", height, to_height).select(*PIXEL, "r", "g", "b")
