import io
import zipfile
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.model import preset
from lamina.operators import background, components, ink, layers, metrics, pixels, text, textlayers
from lamina.sources import derived, files
from lamina.streaming import jobs

PAPER = (250, 250, 250)


def image(spark, rows, image_id=1, colours=None):
    """Pixels of a drawing: a letter for each colour, dots for paper."""
    colours = {"#": (10, 20, 30), "o": (200, 30, 30)} | (colours or {})
    data = [(image_id, y, x, *colours.get(c, PAPER)) for y, row in enumerate(rows) for x, c in enumerate(row)]
    return spark.createDataFrame(data, "image_id long, y int, x int, r int, g int, b int")


def paper(spark, *ids):
    return spark.createDataFrame([(i, *PAPER) for i in ids], "image_id long, bg_r int, bg_g int, bg_b int")


def found(spark, rows):
    px = image(spark, rows)
    mask = pixels.foreground(pixels.with_distance(px, paper(spark, 1)), 24)
    return components.labelled(components.runs(mask))


def test_shapes_that_join_late_or_at_corners_are_one(spark):
    u = ["#..#", "#..#", "####", "....", "#...", ".#..", "..#."]
    c = components.components(found(spark, u)).orderBy("component_id").collect()
    assert [(r["area"], r["x"], r["y"], r["width"], r["height"]) for r in c] == [(8, 0, 0, 4, 3), (3, 0, 4, 3, 3)]


def test_no_components_in_a_blank_image(spark):
    assert components.components(found(spark, ["....", "...."])).count() == 0


def test_layers_are_ranked_padded_and_numbered(spark):
    runs = found(spark, ["##..##", "##..##", "......", "###...", "......"])
    top = components.largest(components.components(runs), 2, 1, 2)
    rows = components.layers(top, 1, 6, 5).orderBy("z").collect()
    assert {r["layer_id"] for r in rows} == {"raster_001", "raster_002"} and sorted(r["area"] for r in rows) == [4, 4]
    assert [(r["x"], r["y"], r["width"], r["height"]) for r in rows] == [(3, 0, 3, 3), (0, 0, 3, 3)]
    many = spark.range(1, 1002).select(F.format_string("raster_%03d", F.col("id").cast("int")).alias("n")).where("n = 'raster_1000'")
    assert many.count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_flood_fill_whatever_the_partitions(spark, seed):
    grid = np.random.default_rng(seed).random((12, 15)) < 0.45
    runs = found(spark, ["".join(".#"[int(v)] for v in row) for row in grid]).repartition(5)
    label, seen = {}, 0
    for y, x in np.argwhere(grid):
        if (y, x) not in label:
            seen += 1
            stack = [(y, x)]
            while stack:
                p = stack.pop()
                if p not in label and 0 <= p[0] < 12 and 0 <= p[1] < 15 and grid[p]:
                    label[p] = seen
                    stack += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    c = components.components(runs).collect()
    assert len(c) == seen and sum(r["area"] for r in c) == grid.sum()


def test_palette_ties(spark):
    px = image(spark, ["#o", "o#"])
    assert [r["colour"] for r in background.top_colours(px, 2).orderBy("rank").collect()] == [0xC81818, 0x081818]
    assert background.dominant_colours(px, "image_id").select("r", "g", "b").first() == (10, 20, 30)


def test_medians_round_half_to_even(spark):
    px = spark.createDataFrame([(1, 0, 0, 2, 3, 4), (1, 0, 1, 3, 4, 5)], "image_id long, y int, x int, r int, g int, b int")
    assert background.medians(px, "image_id").select("r", "g", "b").first() == (2, 4, 4)


def test_closing_fills_a_hole_and_keeps_the_outline(spark):
    mask = image(spark, [".......", ".......", "..###..", "..#.#..", "..###..", ".......", "......."]).where("r < 100")
    closed = {(r["y"], r["x"]) for r in pixels.closed(mask, 7, 7).collect()}
    assert closed == {(y, x) for y in (2, 3, 4) for x in (2, 3, 4)}


def test_details_of_a_dark_block(spark):
    rows = ["........", ".######.", ".#oo##o.", ".######.", ".######.", "........"]
    px = image(spark, rows)
    runs = found(spark, rows)
    full = layers.filled_components(runs, components.components(runs), px, 10, 0.9, 0.72)
    assert full.count() == 1
    d = layers.detail_components(runs, full, px, 46, 2).collect()
    assert [(r["detail"], r["area"], r["x"], r["y"], r["width"], r["height"]) for r in d] == [(1, 2, 2, 2, 2, 1)]


def test_partition_tiles_the_component(spark):
    runs = found(spark, ["###........###", "##############", "###........###"])
    parts = layers.partition(runs, area=4, density=0.4, gap=2, depth=9, span=6).collect()
    assert len({r["region"] for r in parts}) > 1
    cells = [(r["y"], x) for r in parts for x in range(r["x_start"], r["x_end"] + 1)]
    assert len(cells) == len(set(cells)) == 26


def test_layers_laid_over_the_background_give_the_image_back(spark):
    px = image(spark, ["#o.", ".#."])
    shown = px.where("r < 250").withColumn("alpha", F.lit(255)).withColumn("z", F.lit(1))
    back = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in layers.composite(paper(spark, 1), shown).collect()}
    assert back == {(0, 0): (10, 20, 30), (0, 1): (200, 30, 30), (1, 1): (10, 20, 30)}


def test_an_image_equals_itself_and_a_blank_one_has_no_edges(spark):
    px = image(spark, ["#o.#", "..#.", "o..#"])
    same = metrics.differences(metrics.aligned(px, px)).first()
    assert (same["mae"], same["rmse"], same["psnr"]) == (0.0, 0.0, 99.0)
    edges = metrics.edges(metrics.gradients(metrics.grey(px)))
    ids = spark.createDataFrame([(1,), (2,)], "image_id long")
    assert {r["image_id"]: r["edge_f1"] for r in metrics.edge_f1(edges, edges, ids).collect()} == {1: 1.0, 2: 1.0}


def test_bands_are_merged_to_the_left_and_the_first_to_the_right(spark):
    rows = spark.createDataFrame([(1, 0, 1, 0), (1, 2, 9, 1), (1, 10, 11, 0), (1, 12, 20, 1)], "key long, start long, end long, code long")
    assert [tuple(r)[1:] for r in ink.merged_bands(rows, "key", "code", 4).orderBy("start").collect()] == [(0, 11, 1), (12, 20, 1)]


def test_fragments_of_a_baseline_become_one_line(spark):
    rows = [(1, 0, "world", 120, 2, 50, 20), (1, 1, "Hello", 10, 0, 60, 20), (1, 2, "below", 10, 80, 60, 20)]
    lines = spark.createDataFrame(rows, "image_id long, line_no int, text string, x int, y int, width int, height int")
    assert [(r["text"], r["parts"]) for r in text.merged_lines(lines).orderBy("line").collect()] == [("Hello world", 2), ("below", 1)]


def test_images_are_read_and_listed(spark, tmp_path):
    for name in ("b.PNG", "a.png", "c.png", "note.txt"):
        (tmp_path / name).write_bytes(files.png(2, 1, bytes([1, 2, 3, 255, 4, 5, 6, 128])))
    px = files.image_pixels(files.read_images(spark, str(tmp_path / "a.png"))).orderBy("x").collect()
    assert [(r["y"], r["x"], r["r"], r["g"], r["b"]) for r in px] == [(0, 0, 1, 2, 3), (0, 1, 4, 5, 6)]
    assert [r["path"].rpartition("/")[2] for r in files.list_images(spark, str(tmp_path), 2).collect()] == ["b.PNG", "c.png"]
    assert files.list_images(spark, str(tmp_path), 1, 1).count() == 1


def test_decks_hold_a_picture_for_each_layer(spark):
    rows = ["##..", "##..", "...#"]
    px, runs = image(spark, rows), found(spark, rows)
    top = components.layers(components.largest(components.components(runs), 1, 1, 9), 0, 4, 3)
    placed = files.placed(top.withColumn("image_width", F.lit(4)).withColumn("image_height", F.lit(3)), F.lit(4), F.lit(3))
    cells = px.where("r < 250").join(top.select("image_id", "layer_id", F.col("x").alias("l"), F.col("y").alias("t"), "width", "height"), "image_id").where("x >= l and x < l + width and y >= t and y < t + height").withColumn("alpha", F.lit(255))
    out = files.decks(placed, cells, paper(spark, 1)).collect()
    z = zipfile.ZipFile(io.BytesIO(out[0]["pptx"]))
    assert len(out) == 1 and sum(n.endswith(".png") for n in z.namelist()) == 2
    slide = z.read("ppt/slides/slide1.xml").decode()
    assert slide.count("<p:pic>") == 2 and 'name="raster_001"' in slide and "FAFAFA" in slide


def test_decks_of_several_slides_with_text(spark):
    rows = ["##..", "...."]
    px, runs = image(spark, rows), found(spark, rows)
    px, runs = (t.unionByName(t.withColumn("image_id", F.lit(2).cast("long"))) for t in (px, runs))
    top = components.layers(components.largest(components.components(runs), 1, 1, 9), 0, 4, 2)
    place = lambda t: files.placed(t.withColumn("image_width", F.lit(4)).withColumn("image_height", F.lit(2)), F.lit(4), F.lit(2))
    cells = px.where("r < 250").withColumn("layer_id", F.lit("raster_001")).withColumn("alpha", F.lit(255))
    run = lambda said, r, g, b, bold: F.struct(F.lit(said).alias("text"), F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"), F.lit(10.5).alias("font_size"), F.lit(bold).alias("bold"))
    runs_ = F.array(run("a < b ", 1, 2, 3, True), run("red", 255, 0, 0, False))
    texts = place(spark.createDataFrame([(1, "text_001", 0, 1, 4, 1, 9)], "image_id long, layer_id string, x int, y int, width int, height int, z int")).withColumn("runs", runs_)
    deck_of = spark.createDataFrame([(1, 7, 2), (2, 7, 1)], "image_id long, deck_id long, slide int")
    out = files.decks(place(top), cells, paper(spark, 1, 2), texts, deck_of).collect()
    z = zipfile.ZipFile(io.BytesIO(out[0]["pptx"]))
    first, second = (z.read(f"ppt/slides/slide{n}.xml").decode() for n in (1, 2))
    assert len(out) == 1 and out[0]["deck_id"] == 7 and "<a:t>" not in first and first.count("<p:pic>") == second.count("<p:pic>") == 1
    assert "<a:t>a &lt; b </a:t>" in second and 'sz="1050" b="1"' in second and 'val="FF0000"' in second and second.index("<p:pic>") < second.index("<p:sp>")
    for name in z.namelist():
        if name.endswith((".xml", ".rels")):
            ElementTree.fromstring(z.read(name))


def test_presets():
    assert preset("auto") == preset("balanced") and preset("heavy", True).min_area_px == 18


def test_jobs_are_followed_as_a_stream(spark, tmp_path):
    events = derived.job_events(spark, "/root/testdata/sf0.001")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = jobs.follow(stream, str(tmp_path / "states"), str(tmp_path / "checkpoint"))
    q.awaitTermination(60)
    key = lambda t: sorted(map(tuple, t.select("job_id", "status", "progress", "phase", "message", "events").collect()))
    assert key(jobs.latest(spark.read.parquet(str(tmp_path / "states")))) == key(jobs.current(events))


def test_a_word_of_two_colours_is_split_in_proportion(spark):
    px = image(spark, ["." * 2 + "#" * 12 + "o" * 12 + "." * 2] * 4)
    words = spark.createDataFrame([(1, 0, 0, "HelloWorld", 2, 0, 24, 4), (1, 1, 0, "Tiny", 2, 0, 24, 4)], "image_id long, line_no int, word_no int, text string, x int, y int, width int, height int")
    rows = textlayers.split_words(words, px, paper(spark, 1), 35, 28, 4).orderBy("run").collect()
    assert [r["text"] for r in rows] == ["Hello", "World"]


def test_a_word_of_one_colour_is_left_alone(spark):
    px = image(spark, ["#" * 20] * 4)
    words = spark.createDataFrame([(1, 0, 0, "HelloWorld", 0, 0, 20, 4)], "image_id long, line_no int, word_no int, text string, x int, y int, width int, height int")
    assert textlayers.split_words(words, px, paper(spark, 1), 35, 20, 4).count() == 0


def test_text_is_painted_over_and_the_rest_stays(spark):
    rows = ["." * 20 for _ in range(16)]
    rows[7] = "......####.........."
    rows[0] = "#..................."
    words = spark.createDataFrame([(1, 0, 0, "word", 6, 7, 4, 1)], "image_id long, line_no int, word_no int, text string, x int, y int, width int, height int")
    px = image(spark, rows)
    out = textlayers.without_text(px, words, 20, 16)
    ink_left = [(r["y"], r["x"]) for r in out.where("r < 100").collect()]
    assert ink_left == [(0, 0)] and out.count() == 320
    assert textlayers.without_text(px, words.where("false"), 20, 16).where("r < 100").count() == 5


def test_decks_are_written_as_files_and_images_are_watched(spark, tmp_path):
    from lamina.sources import decks

    decks.register(spark)
    rows = spark.createDataFrame([("a", bytearray(b"one")), ("b", bytearray(b"two"))], "name string, pptx binary")
    rows.write.format("pptx").mode("append").save(str(tmp_path / "out"))
    left = lambda: {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
    assert left() == {"a.pptx": b"one", "b.pptx": b"two"}
    with pytest.raises(Exception, match="one name"):
        rows.unionByName(rows).write.format("pptx").mode("append").save(str(tmp_path / "out"))
    assert left() == {"a.pptx": b"one", "b.pptx": b"two"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.png").write_bytes(files.png(1, 1, bytes(4)))
    (tmp_path / "in" / "x.txt").write_text("no")
    q = decks.watched_images(spark, str(tmp_path / "in")).select("path").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["path"].rpartition("/")[2] for r in spark.table("seen").collect()] == ["x.png"]


def test_a_cut_component_becomes_several_layers(spark):
    from lamina.model import SegmentOptions
    from lamina.plans.engine import extract_layers

    rows = ["." * 16, ".###........###.", ".##############.", ".###........###.", *["." * 16] * 5]
    options = SegmentOptions(24, None, 2, 1, 20, 0, 0, 4, 55, True)
    out = extract_layers(image(spark, rows), 16, 9, options, partition={"area": 4, "density": 0.4, "gap": 2, "depth": 9, "span": 6}).collect()
    assert len(out) > 1 and sum(r["area"] for r in out) == 26
    whole = extract_layers(image(spark, rows), 16, 9, SegmentOptions(24, None, 2, 1, 20, 0, 0, 4, 55)).collect()
    assert [(r["layer_id"], r["area"], r["z"]) for r in whole] == [("raster_001", 26, 1)]


def test_details_and_surfaces_are_layers_of_their_own(spark):
    from lamina.model import SegmentOptions
    from lamina.plans.engine import extract_layers

    rows = ["." * 12, ".######.....", ".#oo###.....", ".######.ppp.", ".######.ppp.", *["." * 12] * 6]
    px = image(spark, rows, colours={"p": (240, 240, 240)})
    options = SegmentOptions(24, 12, 2, 1, 20, 0, 0, 4, 55, False, True)
    out = {r["layer_id"]: r["area"] for r in extract_layers(px, 12, 11, options, 2, details={"min_area": 4, "min_ratio": 0.4, "min_detail": 2}).collect()}
    assert out == {"raster_001_base": 24, "raster_001_detail_001": 2, "surface_001": 6}
