import numpy as np

from lamina.model import SegmentOptions
from lamina.operators import background as bg
from lamina.operators import strips


def images(spark, n: int):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(i, y, x, *map(int, rng.integers(0, 3, 3) * 100)) for i in range(n) for y in range(11) for x in range(9)], "image_id long, y int, x int, r int, g int, b int")


def test_colours_of_many_strips_are_counted_at_once(spark, monkeypatch):
    px = images(spark, 7).cache()
    whole = sorted(map(tuple, bg.colour_counts(px, 9, 11).select("image_id", "r", "g", "b", "n", "border", "corner").collect()))
    for at_once in (1, 100, 1 << 19):  # a strip, some strips, all
        monkeypatch.setattr(strips, "PIXELS", at_once)
        counts = strips.colour_counts(strips.strips_of_pixels(px, 9, 11, 4), 4)
        assert sorted(map(tuple, counts.select("image_id", "r", "g", "b", "n", "border", "corner").collect())) == whole


def test_strips_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    own = strips.strips_of_pixels(images(spark, 3), 9, 11, 4).mapInArrow(seen, strips.STRIP)
    assert strips.layers(own, 9, 11, SegmentOptions(24, None, 2, 1, 4, 0, 1, 4, 55), 4).count() > 0
    assert made.value == 9
