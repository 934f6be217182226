"""Background colours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.pixels import luma, packed, quantised, squared_distance, unpacked

RGB = ["r", "g", "b"]


def medians(pixels: DataFrame, *keys: str) -> DataFrame:
    """The median of each channel, rounded half to even."""
    return pixels.groupBy(*keys).agg(*[F.bround(F.median(c)).cast("int").alias(c) for c in RGB])


def corner_pixels(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """The four corner patches; pixels in several patches count for each."""
    side = max(8, min(width, height) // 24)
    near = lambda c, n: (F.col(c) < side, F.col(c) >= n - side)
    return reduce(DataFrame.unionAll, [pixels.where(v & h) for v in near("y", height) for h in near("x", width)])


def border_pixels(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """The four edge bands; corner pixels count twice."""
    band = max(2, min(width, height) // 18)
    parts = [F.col("y") < band, F.col("y") >= height - band, F.col("x") < band, F.col("x") >= width - band]
    return reduce(DataFrame.unionAll, [pixels.where(p) for p in parts])


def corner_background(pixels: DataFrame, width: int, height: int) -> DataFrame:
    return medians(corner_pixels(pixels, width, height), "image_id").select("image_id", *[F.col(c).alias(f"bg_{c}") for c in RGB])


def top_colours(pixels: DataFrame, limit: int) -> DataFrame:
    """image_id, rank, colour (packed), n: the most frequent quantised colours, ties to the larger one."""
    counts = pixels.groupBy("image_id", quantised(*map(F.col, RGB)).alias("colour")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("image_id").orderBy(F.desc("n"), F.desc("colour"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def colour_counts(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, r, g, b, n, border, corner: how many pixels have a colour, and how often the edge bands and the corner patches hold it."""
    at = lambda c, size, n: (F.col(c) < size).cast("int") + (F.col(c) >= n - size).cast("int")
    band, side = max(2, min(width, height) // 18), max(8, min(width, height) // 24)
    border, corner = at("y", band, height) + at("x", band, width), at("y", side, height) * at("x", side, width)
    return pixels.groupBy("image_id", *RGB).agg(F.count("*").alias("n"), F.sum(border).alias("border"), F.sum(corner).alias("corner"))


def weighted_medians(colours: DataFrame, weight: str) -> DataFrame:
    """image_id and the median of each channel, rounded half to even, of colours that stand for so many pixels."""
    return colours.where(F.col(weight) > 0).groupBy("image_id").agg(*[F.bround(F.percentile(c, 0.5, F.col(weight))).cast("int").alias(c) for c in RGB])


#: So many frequent colours of an image, and of its edge bands, may be its background.
FREQUENT, FREQUENT_AT_EDGES = 12, 8


def candidate_lists(counts: DataFrame) -> DataFrame:
    """image_id, n, border (of all its colours), own: every distinct candidate for an image's background (ord, r, g, b), the one of least ord where several are the same."""

    def top(weight: str, limit: int, first: int) -> Column:
        found = F.sort_array(F.collect_list(F.when(F.col(weight) > 0, F.struct(weight, "colour"))), False)
        return F.transform(F.slice(found, 1, limit), lambda s, i: F.struct((i + first).alias("ord"), s["colour"].alias("colour")))

    cells = counts.groupBy("image_id", quantised(*map(F.col, RGB)).alias("colour")).agg(F.sum("n").alias("n"), F.sum("border").alias("border"))
    tops = cells.groupBy("image_id").agg(top("n", FREQUENT, 1).alias("most"), top("border", FREQUENT_AT_EDGES, FREQUENT + 1).alias("edges"), F.sum("n").alias("n"), F.sum("border").alias("border"))
    corner = weighted_medians(counts, "corner").select("image_id", F.array(F.struct(F.lit(0).alias("ord"), packed(*map(F.col, RGB)).alias("colour"))).alias("corner"))
    every = tops.join(corner, "image_id", "left").select("image_id", "n", "border", F.concat(F.coalesce("corner", F.slice("most", 1, 0)), "most", "edges").alias("own"))
    distinct = F.filter("own", lambda s, i: F.array_position(F.col("own")["colour"], s["colour"]) == i + 1)
    rgb = lambda s: [c.alias(n) for n, c in zip(RGB, unpacked(s["colour"]), strict=True)]
    return every.withColumn("own", F.transform(distinct, lambda s: F.struct(s["ord"].alias("ord"), *rgb(s))))


def candidates_of(counts: DataFrame) -> DataFrame:
    """image_id, r, g, b, ord, coverage, border_coverage, luma: every distinct candidate for an image's background. Colours meet the candidates, not pixels, and only those near one are added up."""
    lists = candidate_lists(counts)
    met = counts.join(lists.select("image_id", "own"), "image_id").select("image_id", "n", "border", *RGB, F.explode("own").alias("c"))
    near = met.where(squared_distance(F.col("c.r"), F.col("c.g"), F.col("c.b")) <= 900).groupBy("image_id", "c.ord").agg(F.sum("n").alias("near"), F.sum("border").alias("border_near"))
    each = lists.select("image_id", "n", "border", F.explode("own").alias("c")).select("image_id", "n", "border", "c.*").join(near, ["image_id", "ord"], "left")
    share = lambda part, of: F.coalesce(part, F.lit(0)) / F.col(of)
    return each.select("image_id", *RGB, "ord", share("near", "n").alias("coverage"), share("border_near", "border").alias("border_coverage")).withColumn("luma", luma(*map(F.col, RGB)))


def background_of(counts: DataFrame) -> DataFrame:
    """image_id, bg_r, bg_g, bg_b: the candidate that covers most, refined to the median of the pixels near it. counts: of colour_counts()."""
    key = F.struct("coverage", "border_coverage", "luma", -F.col("ord"))
    best = candidates_of(counts).groupBy("image_id").agg(F.max_by(F.struct(*RGB), key).alias("c")).select("image_id", *[F.col(f"c.{c}").alias(f"c_{c}") for c in RGB])
    near = counts.join(best, "image_id").where(squared_distance(F.col("c_r"), F.col("c_g"), F.col("c_b")) <= 900)
    return best.join(weighted_medians(near, "n"), "image_id", "left").select("image_id", *[F.coalesce(c, f"c_{c}").alias(f"bg_{c}") for c in RGB])


def scored_candidates(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Candidates for the background of images of one size, of their pixels: see candidates_of()."""
    return candidates_of(colour_counts(pixels, width, height))


def background(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """The background of images of one size, of their pixels: see background_of()."""
    return background_of(colour_counts(pixels, width, height))


def dominant_colours(pixels: DataFrame, *keys: str) -> DataFrame:
    """Keys, r, g, b: the median of the pixels near the most frequent quantised colour, ties to the smaller one."""
    mode = pixels.groupBy(*keys).agg(F.mode(quantised(*map(F.col, RGB)), True).alias("mode"))
    joined = pixels.join(mode, list(keys))
    near = joined.where(squared_distance(*unpacked(F.col("mode"))) <= 784)
    found = medians(near, *keys)
    return mode.join(found, list(keys), "left").select(*keys, *[F.coalesce(c, u).alias(c) for c, u in zip(RGB, unpacked(F.col("mode")), strict=True)])
