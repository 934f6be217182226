import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import image, paper
from test_strips import as_pixels, random_images

from lamina.model import SegmentOptions
from lamina.operators import pixels, text, textlayers
from lamina.plans import engine
from lamina.sources import files

WORD = "image_id long, line_no int, word_no int, text string, x int, y int, width int, height int"


def convolved(picture, axis, to):
    """By hand: every source's weight, rounded to 22 bits, and one rounding at the end of the axis."""
    picture = np.moveaxis(picture.astype(np.int64), axis, 0)
    size = len(picture)
    step = size / to
    wide = max(1.0, step)
    out = np.zeros((to, *picture.shape[1:]), np.int64)
    lobe = lambda v: 0.0 if abs(v) >= 3 else 1.0 if v == 0 else 3 * math.sin(math.pi * v) * math.sin(math.pi * v / 3) / (math.pi * v) ** 2
    for place in range(to):
        w = np.array([lobe((s + 0.5 - (place + 0.5) * step) / wide) for s in range(size)])
        out[place] = np.tensordot(np.rint(w / w.sum() * 2**22).astype(np.int64), picture, 1)
    return np.moveaxis(np.clip((out + 2**21) >> 22, 0, 255), 0, axis)


@pytest.mark.parametrize(("to_width", "to_height"), [(31, 9), (50, 23), (7, 40)])
def test_resizing_equals_a_convolution(spark, to_width, to_height):
    images = random_images(2, n=2)
    out = np.zeros((2, to_height, to_width, 3))
    rows = pixels.resized(as_pixels(spark, images), 31, 23, to_width, to_height).collect()
    assert len(rows) == 2 * to_width * to_height
    for r in rows:
        out[r["image_id"], r["y"], r["x"]] = r["r"], r["g"], r["b"]
    for i in range(2):
        wide = convolved(images[i], 1, to_width) if to_width != 31 else images[i]
        assert (out[i] == (convolved(wide, 0, to_height) if to_height != 23 else wide)).all()


def test_a_word_of_two_colours_is_two_runs_of_its_box(spark):
    px = image(spark, [*["." * 28] * 6, *["." * 2 + "#" * 12 + "o" * 12 + "." * 2] * 4, *["." * 28] * 6])
    words = spark.createDataFrame([(1, 0, 0, "HelloWorld", 2, 6, 24, 4)], WORD)
    options = SegmentOptions(24, None, 2, 1, 20, 0, 0, 4, 55)
    found = engine.image_to_layers(px, words, 28, 16, options, "all")
    (layer,) = found.texts.collect()
    assert [(r["text"], r["r"], r["g"], r["b"]) for r in layer["runs"]] == [("Hello", 10, 20, 30), ("World", 200, 30, 30)]
    placed = lambda t: files.placed(t.withColumn("image_width", F.lit(28)).withColumn("image_height", F.lit(16)), F.lit(28), F.lit(16))
    top = image(spark, ["#"]).select("image_id", F.lit("raster_001").alias("layer_id"), F.lit(1).alias("z"), *[F.lit(v).alias(c) for c, v in (("x", 0), ("y", 0), ("width", 2), ("height", 2))])
    cells = image(spark, ["#"]).withColumns({"layer_id": F.lit("raster_001"), "alpha": F.lit(9)})
    texts = placed(found.texts.withColumn("z", F.lit(2)))
    (deck,) = files.decks(placed(top), cells, paper(spark, 1), texts).collect()
    z = zipfile.ZipFile(io.BytesIO(deck["pptx"]))
    slide = z.read("ppt/slides/slide1.xml").decode()
    assert slide.index('val="0A141E"') < slide.index("<a:t>Hello</a:t>") < slide.index('val="C81E1E"') < slide.index("<a:t>World</a:t>")
    (name,) = [n for n in z.namelist() if n.endswith(".png")]
    assert z.read(name) == files.png(2, 2, bytes([10, 20, 30, 9, *[0] * 12]))


def test_words_of_several_colours_keep_their_own(spark):
    px = image(spark, ["##.oo"] * 3)
    words = spark.createDataFrame([(1, 0, 0, "ab", 0, 0, 2, 3), (1, 0, 1, "cd", 3, 0, 2, 3)], WORD)
    (layer,) = textlayers.text_layers(words, px, paper(spark, 1), 35, 5, 3).collect()
    assert [r["text"] for r in layer["runs"]] == ["ab ", "cd"] and layer["words"] == 2


def test_recognised_fragments_become_lines(spark):
    rows = [
        (1, 0, "red", 0, "red", 100.0, 10.0, 40.0, 20.0), (1, 1, "Very", 0, "Very", 10.0, 11.0, 60.0, 20.0),  # one baseline, right part first
        (1, 2, "RED", 0, "RED", 101.0, 10.0, 40.0, 20.0),  # the same again
        (1, 3, "own text", 0, "own", 10.0, 90.0, 30.0, 20.0), (1, 3, "own text", 1, "words", 5.0, 90.0, 30.0, 20.0), (1, 4, "", 0, " ", 0.0, 0.0, 1.0, 1.0),
    ]
    raw = spark.createDataFrame(rows, "image_id long, line_no int, line_text string, word_no int, word_text string, x double, y double, width double, height double")
    words, lines = text.regrouped(*text.recognised(raw))
    assert [tuple(r) for r in lines.orderBy("line_no").select("line_no", "text", "x", "y", "width", "height", "words").collect()] == [(0, "Very red", 10, 10, 130, 21, 2), (1, "own text", 5, 90, 35, 20, 2)]
    assert [tuple(r) for r in words.orderBy("line_no", "word_no").select("line_no", "word_no", "text").collect()] == [(0, 0, "Very"), (0, 1, "red"), (1, 0, "own"), (1, 1, "words")]
    none = text.regrouped(*text.recognised(raw.where("false")))
    assert none[0].count() == none[1].count() == 0
