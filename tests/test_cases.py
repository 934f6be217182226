import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import background as bg
from lamina.operators import components as cc
from lamina.operators import layers as ly
from lamina.operators import metrics, pixels
from lamina.plans import engine

WIDTH, HEIGHT = 9, 7
MASKS = [(40, 0), (60, 1), (90, 3), (1000, 1)]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(11)
    return spark.createDataFrame([(i, y, x, *map(int, rng.integers(0, 5, 3) * 50)) for i in (0, 2, 3, 9) for y in range(HEIGHT) for x in range(WIDTH)], "image_id long, y int, x int, r int, g int, b int").cache()


@pytest.fixture(scope="module")
def distances(images):
    ground = images.select("image_id").distinct().select("image_id", *[F.lit(100).alias(f"bg_{c}") for c in "rgb"])
    return pixels.with_distance(images, ground).cache()


def case(df, k, n):
    return df.withColumn("image_id", F.col("image_id") * n + k)


def test_runs_of_several_masks(distances):
    mine = cc.labelled_cases(distances, MASKS, WIDTH, HEIGHT)
    theirs = []
    for k, (threshold, radius) in enumerate(MASKS):
        mask = distances.where(F.col("d2") > threshold * threshold)
        theirs += rows(case(cc.labelled(cc.runs(pixels.dilated(mask, radius, WIDTH, HEIGHT))), k, len(MASKS)).select(mine.columns))
    assert rows(mine) == sorted(theirs)


def test_surfaces_of_several_masks(distances):
    masks = [(120, 1, 60), None, (140, 2, 90), (150, 1, 149)]
    mine = cc.surface_cases(distances, masks, WIDTH, HEIGHT, 3)
    theirs = []
    for k, mask in enumerate(masks):
        if mask:
            threshold, radius, low = mask
            left = distances.where(F.col("d2") > low * low).join(pixels.dilated(distances.where(F.col("d2") > threshold * threshold), radius, WIDTH, HEIGHT), pixels.PIXEL, "left_anti")
            enough = left.groupBy("image_id").count().where("count >= 3")
            theirs += rows(case(left.join(enough, "image_id", "left_semi"), k, len(masks)).select(mine.columns))
    assert theirs and rows(mine) == sorted(theirs)


def test_renders_are_compared_in_the_rows_of_their_pixels(spark, images):
    rng = np.random.default_rng(4)
    ground = images.select("image_id").distinct().select("image_id", *[F.lit(v).alias(f"bg_{c}") for c, v in zip("rgb", (200, 90, 10), strict=True)])
    layers = [(i, k, z, y, x, *map(int, rng.integers(0, 256, 4))) for i in (0, 2, 9) for k in (0, 2) for z in (3, 1, 2) for y in range(HEIGHT) for x in range(WIDTH) if rng.random() < 0.3]
    cells = spark.createDataFrame(layers, "image_id long, place int, z int, y int, x int, r int, g int, b int, alpha int")
    mine = {(r["image_id"], r["place"]): (r["mae"], r["edge_f1"]) for r in metrics.compared(ly.laid_out(images, ground, cells, 3), 3).collect()}
    edges = lambda p: metrics.edges(metrics.gradients(metrics.grey(p)))
    theirs = {}
    for k in range(3):
        over = ly.composite(ground, cells.where(F.col("place") == k)).select(*pixels.PIXEL, *[F.col(c).alias(f"l_{c}") for c in "rgb"])
        render = images.select(*pixels.PIXEL).join(ground, "image_id").join(over, pixels.PIXEL, "left").select(*pixels.PIXEL, *[F.coalesce(f"l_{c}", f"bg_{c}").alias(c) for c in "rgb"])
        scores = metrics.differences(metrics.aligned(images, render)).join(metrics.edge_f1(edges(images), edges(render), ground.select("image_id")), "image_id")
        theirs |= {(r["image_id"], k): (r["mae"], r["edge_f1"]) for r in scores.collect()}
    assert mine == theirs


def counted(spark, images):
    """Images, and how often each of their pixels was read."""
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return images.mapInArrow(through, images.schema), lambda: seen.value / images.count()


def test_a_race_reads_pixels_a_few_times(spark, images):
    """Once for the comparison of all renders, however many they are."""
    px, times = counted(spark, images)
    assert engine.race(px, WIDTH, HEIGHT, engine.small_candidates(), **engine.GATES).count() == 4
    assert times() <= 8


def test_backgrounds_read_counts_of_colours_that_are_made_once(spark, images):
    px, times = counted(spark, images)
    assert engine.extract_layers(px, WIDTH, HEIGHT, engine.SMALL).count()
    assert times() <= 2


def test_a_colour_is_a_candidate_once_and_meets_those_near_it(spark):
    """A corner's colour that is a frequent one's too, and a frequent one of the edges only."""
    counts = spark.createDataFrame([(1, 8, 8, 8, 5, 4, 4), (1, 20, 8, 8, 4, 0, 0), (1, 200, 200, 200, 1, 2, 0)], "image_id long, r int, g int, b int, n long, border long, corner long")
    found = [(r["r"], r["g"], r["b"], r["ord"], round(r["coverage"], 6), round(r["border_coverage"], 6)) for r in bg.candidates_of(counts).orderBy("ord").collect()]
    assert found == [(8, 8, 8, 0, 0.9, 0.666667), (24, 8, 8, 2, 0.9, 0.666667), (200, 200, 200, 3, 0.1, 0.333333)]
