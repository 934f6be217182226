import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.model import SegmentOptions
from lamina.operators import background as bg
from lamina.operators import components as cc
from lamina.operators import strips
from lamina.plans import engine


def random_images(seed, n=6, height=23, width=31):
    """Blots and noise on paper."""
    rng = np.random.default_rng(seed)
    out = np.full((n, height, width, 3), 240, np.uint8)
    for image in out:
        for _ in range(9):
            y, x, h, w = rng.integers(0, height), rng.integers(0, width), rng.integers(1, 9), rng.integers(1, 12)
            image[y : y + h, x : x + w] = rng.integers(0, 255, 3)
        noise = rng.random((height, width)) < 0.05
        image[noise] = rng.integers(0, 255, (int(noise.sum()), 3))
    return out


def as_pixels(spark, images):
    rows = [(i, y, x, *map(int, images[i, y, x])) for i, y, x in np.ndindex(images.shape[:3])]
    return spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int").repartition(4)


def as_strips(spark, images, rows):
    """As read from files: bytes b, g, r."""
    n, height, width, _ = images.shape
    files = spark.createDataFrame([(i, width, height, 3, images[i][:, :, ::-1].tobytes()) for i in range(n)], "image_id long, width int, height int, channels int, data binary")
    return strips.strips_of(files, rows)


def collected(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("seed", "rows"), [(1, 3), (2, 7)])
def test_labels_of_strips_equal_labels_of_whole_images(spark, seed, rows):
    rng = np.random.default_rng(seed)
    cells = [(i, y, x) for i, y, x in np.ndindex(8, 40, 30) if rng.random() < 0.35 + 0.05 * (i % 3)]
    mask = spark.createDataFrame(cells, "image_id long, y int, x int")
    whole = cc.labelled(cc.runs(mask)).select("image_id", "y", "x_start", "x_end", "run_id", "component_id")
    own = cc.labelled_strips(cc.numbered(cc.runs(mask).drop("run_id"), rows), rows).select(whole.columns)
    assert collected(own) == collected(whole)
    assert cc.labelled_strips(cc.numbered(cc.runs(mask.where("false")).drop("run_id"), rows), rows).count() == 0


def test_strips_and_their_colours_equal_those_of_pixels(spark):
    images = random_images(3)
    px, own = as_pixels(spark, images), as_strips(spark, images, 5)
    assert collected(strips.strips_of_pixels(px, 31, 23, 5).select(own.columns)) == collected(own)
    assert collected(strips.colour_counts(own, 5)) == collected(bg.colour_counts(px, 31, 23))


@pytest.mark.parametrize(("radius", "rows"), [(0, 4), (1, 3), (3, 3)])
def test_layers_of_strips_equal_layers_of_pixels(spark, radius, rows):
    images = random_images(10 + radius)
    options = SegmentOptions(35, None, 6, 2, 5, radius, 2, 12, 70)
    whole = engine.extract_layers(as_pixels(spark, images), 31, 23, options)
    assert collected(strips.layers(as_strips(spark, images, rows), 31, 23, options, rows).select(whole.columns)) == collected(whole)


def test_foreground_is_counted_from_colours(spark):
    images = random_images(4)
    counts = strips.colour_counts(as_strips(spark, images, 6), 6)
    background = bg.background_of(counts)
    found = dict(map(tuple, strips.foreground_pixels(counts, background, 30).collect()))
    for i, *colour in background.collect():
        assert found[i] == (((images[i].astype(int) - colour) ** 2).sum(axis=2) > 900).sum()


def test_cases_equal_runs_of_each_candidate_alone(spark):
    px = as_pixels(spark, random_images(5, n=4, height=16, width=18))
    candidates = engine.small_candidates()
    cases = engine.Cases(candidates)
    found = engine.extract_cases(px, 18, 16, candidates, **engine.GATES)
    for place, candidate in enumerate(candidates):
        alone = engine.extract(px, 18, 16, candidate.options, **engine.GATES)
        mine = lambda t: t.where(cases.place() == place).withColumn("image_id", cases.image())  # noqa: B023, E731
        for a, b in ((found.layers, alone.layers), (found.cells, alone.cells), (found.background, alone.background), (found.stats, alone.stats)):
            assert collected(mine(a).select(b.columns)) == collected(b), candidate.name


def test_race_falls_back_to_the_local_score(spark):
    px = as_pixels(spark, random_images(6, n=3, height=12, width=12))
    candidates = engine.small_candidates()
    local = {r["image_id"]: r for r in engine.race(px, 12, 12, candidates, **engine.GATES).collect()}
    other = (local[1]["ord"] + 1) % 5
    votes = spark.createDataFrame([(0, 1, 99, True), (1, 1, other, True), (1, 2, other, True), (1, 3, local[1]["ord"], True), (2, 1, 0, False)], "image_id long, model_ord int, winner_index int, ok boolean")
    found = {r["image_id"]: (r["ord"], r["selected_by"], r["votes"]) for r in engine.race(px, 12, 12, candidates, votes, **engine.GATES).collect()}
    assert found == {0: (local[0]["ord"], "judges", 0), 1: (other, "judges", 2), 2: (local[2]["ord"], "local_score", 0)}
    assert {r["selected_by"] for r in local.values()} == {"local_score"}


def test_details_of_touching_components_stay_apart(spark):
    from lamina.operators import layers as ly

    far = spark.createDataFrame([(1, 1, 0, 0), (1, 1, 0, 1), (1, 2, 0, 2), (1, 2, 0, 3), (1, 2, 1, 3)], "image_id long, component_id int, y int, x int")
    found = ly.details_of(ly.detail_spans(far), 2).select("component_id", "detail", "area", "x", "width")
    assert collected(found) == [(1, 1, 2, 0, 2), (2, 1, 3, 2, 2)]
    assert found.where(F.col("detail") > 1).count() == 0
