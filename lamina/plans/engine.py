"""From pixels to layers in one plan, by options or preset."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.model import SegmentOptions, preset
from lamina.operators import background as bg
from lamina.operators import components as cc
from lamina.operators import layers as ly
from lamina.operators import metrics, pixels, selection, strips, text
from lamina.operators import textlayers as tl
from lamina.plans.images import BEST, COMPS, CORNER, DIFF, DIST, F1, LABELS, LAYERS, MASK, SIDE, images, mask, sql
from lamina.plans.inks import cuts_sql
from lamina.plans.races import SCORED
from lamina.plans.registry import query
from lamina.plans.textlayers import ERASE, OCR as OCR_LINES, words
from lamina.sources.derived import PIXELS, VOTES, votes
from lamina.sources.tables import written

COLUMNS = ["image_id", "layer_id", "area", "x", "y", "width", "height"]
CELLS = ["image_id", "layer_id", "y", "x", "r", "g", "b", "alpha"]
ID = ["image_id", "component_id"]


class Extracted(NamedTuple):
    layers: DataFrame  # COLUMNS and z (1: at the bottom)
    cells: DataFrame  # CELLS: pixels of each layer that show
    background: DataFrame  # image_id, bg_r, bg_g, bg_b
    stats: DataFrame  # image_id, foreground_pixels, raw_components


class Candidate(NamedTuple):
    name: str
    options: SegmentOptions


class Cases:
    """Every image with every candidate. A case has image_id * n + the candidate's place as its image_id, so that all operators take cases for images; what a candidate asks for is an expression of that."""

    def __init__(self, candidates: list[Candidate]):
        self.candidates, self.n = candidates, len(candidates)

    def image(self) -> Column:
        return F.expr(f"(image_id - pmod(image_id, {self.n})) div {self.n}") if self.n > 1 else F.col("image_id")  # not by /, which makes doubles of ids

    def place(self) -> Column:
        return F.pmod("image_id", F.lit(self.n)).cast("int")

    def option(self, name: str) -> Column:
        """The case's value of an option."""
        return F.array(*[F.lit(getattr(c.options, name)) for c in self.candidates])[self.place()]

    def name(self) -> Column:
        return F.array(*[F.lit(c.name) for c in self.candidates])[self.place()]

    def asked(self, name: str) -> bool:
        return any(getattr(c.options, name) for c in self.candidates)

    def spread(self, rows: DataFrame, *options: str, on: Callable[[Column], Column] | None = None) -> DataFrame:
        """Rows of images as rows of their cases, with some options. on: which cases, by the struct of these options."""
        each = F.array(*[F.struct(F.lit(i).alias("place"), *[F.lit(getattr(c.options, k)).cast("int").alias(k) for k in options]) for i, c in enumerate(self.candidates)])
        some = F.filter(each, on) if on else each
        others = [c for c in rows.columns if c != "image_id"]
        return rows.select("*", F.explode(some).alias("case")).select((F.col("image_id") * self.n + F.col("case.place")).alias("image_id"), *others, *[f"case.{k}" for k in options])


def boxes(found: DataFrame, name: Column, pad: Column, width: int, height: int) -> DataFrame:
    """COLUMNS of components or details, with padded boxes."""
    box = pixels.padded({k: F.col(k) for k in ("x", "y", "width", "height")}, pad, F.lit(width), F.lit(height))
    return found.select("image_id", name.alias("layer_id"), "area", *[v.alias(k) for k, v in box.items()])


def extract_cases(px: DataFrame, width: int, height: int, candidates: list[Candidate], surface_least: int = 800, partition: dict | None = None, details: dict | None = None) -> Extracted:
    """Layers of images of one size by each candidate, with their pixels, in one plan. Its image_id is a case's: see Cases.

    Thresholds, opacities, minima and gates are values of the cases' rows, so that masks, labels and layers of all cases
    are made at once; steps that no candidate asks for are not in the plan. What several steps read is written to the
    shared folder, which keeps plans short and survives lost executors; those jobs run before this returns. partition: arguments of layers.partition;
    details: min_area, min_ratio, max_luma, distance and min_detail of components with marks inside.
    """
    cases = Cases(candidates)
    own_background = written(bg.background_of(written(bg.colour_counts(px, width, height))))
    distances = written(pixels.with_distance(px, own_background))
    mask = cases.spread(distances, "bg_threshold", on=lambda c: F.col("d2") > c["bg_threshold"] * c["bg_threshold"])
    options = [c.options for c in candidates]
    runs = written(cc.labelled_cases(distances, [(o.bg_threshold, o.dilation_px) for o in options], width, height))
    every = cc.components(runs)
    stats = mask.groupBy("image_id").agg(F.count("*").alias("foreground_pixels")).join(every.groupBy("image_id").agg(F.count("*").alias("raw_components")), "image_id")
    found = cc.largest(every, *map(cases.option, ("min_area_px", "min_bbox_px", "max_layers")))
    if cases.asked("partition"):
        cut = cases.option("partition")
        parts = ly.partition(runs.where(cut).join(found.select(*ID), ID, "left_semi"), **(partition or {}))
        cells = parts.select(*ID, "region", "y", F.explode(F.sequence("x_start", "x_end")).alias("x"))
        spans = cc.runs(cells, *ID, "region").drop("run_id")
        number = F.row_number().over(Window.partitionBy("image_id").orderBy("component_id", "region", "y", "x_start"))
        anew = ly.labelled_regions(spans.withColumn("run_id", number))
        whole = runs.where(~cut).select(anew.columns)
        runs = written(anew.unionByName(whole))
        found = cc.largest(cc.components(runs.where(cut)), 1, 1, cases.option("max_layers")).unionByName(found.where(~cut))
    seen = mask.withColumn("alpha", pixels.alpha(F.col("d2"), cases.option("alpha_low"), cases.option("alpha_high"))).where("alpha > 0")
    shown = written(cc.component_pixels(runs, seen.select(*pixels.PIXEL, "r", "g", "b", "alpha")).join(found.select(*ID, "index"), ID))
    found = found.join(shown.select(*ID).distinct(), ID, "left_semi")
    raster, pad = F.format_string("raster_%03d", "index"), cases.option("crop_padding_px")
    out, cells = boxes(found, raster, pad, width, height), shown.withColumn("layer_id", raster).select(*CELLS)
    if cases.asked("internal_details"):
        d = {"min_area": 9000, "min_ratio": 0.55, "max_luma": 0.72, "distance": 46, "min_detail": 5} | (details or {})
        inner, own_px = runs.where(cases.option("internal_details")), cases.spread(px, "internal_details", on=lambda c: c["internal_details"] == 1).drop("internal_details")
        full = written(ly.filled_components(inner, cc.components(inner), own_px, d["min_area"], d["min_ratio"], d["max_luma"]))
        far = written(ly.detail_pixels(inner, full, own_px, d["distance"], d["min_detail"]))
        spans = ly.detail_spans(far)
        visible = shown.select(*ID, "index", "y", "x", "r", "g", "b", "alpha")
        places = written(spans.select(*ID, "label", "y", F.explode(F.sequence("x_start", "x_end")).alias("x")).join(visible, [*ID, "y", "x"]))
        marks = ly.details_of(spans, d["min_detail"]).join(places.select(*ID, "label", "index").distinct(), [*ID, "label"])
        bases = far.select(*ID).distinct().join(full.select(*ID, *[F.col(c).alias(f"c_{c}") for c in "rgb"]), ID)
        named = F.when(F.col("c_r").isNotNull(), F.concat(raster, F.lit("_base"))).otherwise(raster)
        out = boxes(found.join(bases, ID, "left"), named, pad, width, height)
        covered = shown.join(bases, ID, "left").join(far.withColumn("far", F.lit(True)), [*ID, "y", "x"], "left")
        cells = covered.withColumn("layer_id", named).withColumns({c: F.when(F.col("far"), F.col(f"c_{c}")).otherwise(F.col(c)) for c in "rgb"}).select(*CELLS)
        mark = F.format_string("raster_%03d_detail_%03d", "index", "detail")
        out = out.unionByName(boxes(marks, mark, pad, width, height))
        cells = cells.unionByName(places.join(marks.select(*ID, "label", "detail"), [*ID, "label"]).withColumn("layer_id", mark).select(*CELLS))
    surfaces = [(o.bg_threshold, max(1, o.dilation_px), o.surface_threshold) if o.surface_threshold is not None and o.surface_threshold < o.bg_threshold else None for o in options]
    if any(surfaces):
        subtle = written(cc.surface_cases(distances, surfaces, width, height, surface_least))
        edges = subtle.groupBy("image_id").agg(F.count("*").alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("right"), F.max("y").alias("bottom"))
        edges = edges.withColumn("width", F.col("right") - F.col("x") + 1).withColumn("height", F.col("bottom") - F.col("y") + 1)
        out = out.unionByName(boxes(edges, F.lit("surface_001"), pad, width, height))
        cells = cells.unionByName(subtle.select("image_id", F.lit("surface_001").alias("layer_id"), "y", "x", "r", "g", "b", F.lit(255).alias("alpha")))
    order = Window.partitionBy("image_id").orderBy(F.desc(F.col("width") * F.col("height")), F.desc("y"), F.desc("x"), "layer_id")
    return Extracted(out.withColumn("z", F.row_number().over(order)), cells, cases.spread(own_background), stats)


def extract(px: DataFrame, width: int, height: int, options: SegmentOptions, surface_least: int = 800, partition: dict | None = None, details: dict | None = None) -> Extracted:
    """Layers of images of one size by the same options: see extract_cases()."""
    return extract_cases(px, width, height, [Candidate("", options)], surface_least, partition, details)


def extract_layers(px: DataFrame, width: int, height: int, options: SegmentOptions, surface_least: int = 800, partition: dict | None = None, details: dict | None = None) -> DataFrame:
    """image_id, layer_id, area, x, y, width, height, z of the layers of images of one size: see extract()."""
    return extract(px, width, height, options, surface_least, partition, details).layers


class Result(NamedTuple):
    layers: DataFrame  # image_id, kind, layer_id, text, x, y, width, height, z
    cells: DataFrame  # CELLS of raster layers
    texts: DataFrame  # text layers with font and colour: see textlayers.text_layers
    background: DataFrame
    metadata: DataFrame  # image_id, colour, counts of lines, layers, components and pixels


def image_to_layers(px: DataFrame, words: DataFrame, width: int, height: int, options: SegmentOptions, text_mode: str = "large", erase: bool = True, lines: DataFrame | None = None, **gates) -> Result:
    """The whole way from images and recognised words to layers: lines are told apart and merged, those that stay text are painted over, the rest is segmented, and text layers go on top.

    lines: as text.recognised() gives them with the words; else a line has its words' text.
    """
    words, lines = map(written, text.regrouped(words, tl.box_lines(words) if lines is None else lines))
    kept = written(text.editable(lines, text_mode, height))
    own = words.join(kept.select("image_id", "line_no"), ["image_id", "line_no"], "left_semi")
    source = written(tl.without_text(px, own, width, height)) if erase and text_mode != "none" else px
    found = extract(source, width, height, options, **gates)
    texts = tl.text_layers(own, px, found.background, options.bg_threshold, width, height, kept)
    raster = found.layers.select("image_id", F.lit("raster").alias("kind"), "layer_id", F.lit(None).cast("string").alias("text"), "x", "y", "width", "height", "z")
    top = raster.groupBy("image_id").agg(F.max("z").alias("top"))
    on_top = texts.join(top, "image_id", "left").select("image_id", F.lit("text").alias("kind"), "layer_id", "text", "x", "y", "width", "height", (F.coalesce("top", F.lit(0)) + F.row_number().over(Window.partitionBy("image_id").orderBy("layer_id"))).alias("z"))
    count = lambda t, name: t.groupBy("image_id").agg(F.count("*").alias(name))
    metadata = found.background.withColumn("background_color", F.format_string("#%02x%02x%02x", "bg_r", "bg_g", "bg_b")).select("image_id", "background_color")
    counts = {"ocr_lines": count(lines, "ocr_lines"), "editable_text_lines": count(kept, "editable_text_lines"), "raster_layers": count(found.layers, "raster_layers"), "foreground_pixels": found.stats.select("image_id", "foreground_pixels"), "raw_components": found.stats.select("image_id", "raw_components")}
    for name, table in counts.items():
        metadata = metadata.join(table, "image_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return Result(raster.unionByName(on_top), found.cells, texts, found.background, metadata)


ROW = ("mae", "edge_f1", "raster_layers", "largest_layer_ratio", "internal_detail_layers")


def candidate_rows(px: DataFrame, width: int, height: int, found: Extracted, cases: Cases) -> DataFrame:
    """image_id (a case's) and ROW: how well the layers, laid over the background, give the image back."""
    layers = written(found.layers)
    ids = found.background.select("image_id")
    cells = found.cells.join(layers.select("image_id", "layer_id", "z"), ["image_id", "layer_id"])
    own = cells.withColumns({"place": cases.place(), "image_id": cases.image()})
    background = found.background.where(cases.place() == 0).withColumn("image_id", cases.image())
    scores = metrics.compared(ly.laid_out(px, background, own, cases.n), cases.n).withColumn("image_id", F.col("image_id") * cases.n + F.col("place"))
    counts = layers.groupBy("image_id").agg(F.count("*").alias("raster_layers"))
    features = selection.layer_features(layers, ids, width, height)
    return scores.join(features, "image_id").join(counts, "image_id", "left").select("image_id", "mae", "edge_f1", F.coalesce("raster_layers", F.lit(0)).alias("raster_layers"), "largest_layer_ratio", "internal_detail_layers")


def candidate_row(px: DataFrame, width: int, height: int, found: Extracted) -> DataFrame:
    """image_id and ROW of images by the same options."""
    return candidate_rows(px, width, height, found, Cases([Candidate("", SegmentOptions())]))


def race(px: DataFrame, width: int, height: int, candidates: list[Candidate], votes: DataFrame | None = None, **gates) -> DataFrame:
    """image_id, ord, name, selected_by, votes, local_score and ROW of the candidate that each image's judges choose, or else the local score.

    votes: image_id, model_ord, winner_index, ok; most votes win, then the local score's choice, then the candidate voted
    for first. Where no judge answers, or none names a candidate, the local score chooses.
    """
    cases = Cases(candidates)
    rows = candidate_rows(px, width, height, extract_cases(px, width, height, candidates, **gates), cases)
    exact = selection.local_score(*map(F.col, ROW))
    scored = written(rows.select(cases.image().alias("image_id"), cases.place().alias("ord"), cases.name().alias("name"), *ROW).withColumns({"exact": exact, "local_score": F.round(exact, 9)}))  # rounded, so that ties don't hang on the last digits
    local = selection.best_local(scored)
    if votes is None:
        chosen = local.withColumns({"votes": F.lit(0).cast("long"), "selected_by": F.lit("local_score")})
    else:
        judged = votes.where("ok").select("image_id").distinct().withColumn("judged", F.lit(True))
        chosen = selection.winners(selection.tallies(votes, scored), local).join(judged, "image_id", "left")
        chosen = chosen.select("image_id", "ord", "votes", F.when(F.col("judged"), "judges").otherwise("local_score").alias("selected_by"))
    return chosen.join(scored, ["image_id", "ord"]).select("image_id", "ord", "name", "selected_by", "votes", F.col("exact").alias("local_score"), *ROW)


SMALL = SegmentOptions(24, None, 2, 1, 4, 0, 1, 4, 55)
BG2 = ", bg2 AS (SELECT image_id, coalesce(r, cr) AS bg_r, coalesce(g, cg) AS bg_g, coalesce(b, cb) AS bg_b FROM be LEFT JOIN rf USING (image_id))"
FRAGMENT = BEST + BG2 + DIST[DIST.index(", ds AS") :].replace("JOIN bg ", "JOIN bg2 ") + LAYERS[len(DIST) :]


@query(sql(FRAGMENT, "SELECT image_id, layer_id, area, x, y, width, height, row_number() OVER (PARTITION BY image_id ORDER BY width * height DESC, y DESC, x DESC, layer_id) AS z FROM la"))
def lyr_1_extract_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_layers(images(spark, sf_dir), SIDE, SIDE, SMALL)


@query(sql(FRAGMENT, "SELECT image_id, layer_id, area, x, y, width, height, row_number() OVER (PARTITION BY image_id ORDER BY width * height DESC, y DESC, x DESC, layer_id) AS z FROM la"))
def lyr_1_strip_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same layers from strips of three rows."""
    return strips.layers(strips.strips_of_pixels(images(spark, sf_dir), SIDE, SIDE, 3), SIDE, SIDE, SMALL, 3)


@query(sql(LABELS, "SELECT image_id, run_id, component_id FROM lab"))
def gra_2_strip_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs numbered and labelled strip by strip, and joined at seams."""
    spans = cc.runs(mask(spark, sf_dir)).drop("run_id")
    return cc.labelled_strips(cc.numbered(spans, 3), 3).select("image_id", "run_id", "component_id")


#: Options and gates that images of this size pass.
HEAVY = SegmentOptions(24, 12, 2, 1, 20, 0, 1, 4, 55, True, True)
GATES = {"surface_least": 3, "partition": {"area": 4, "density": 0.3, "gap": 1, "depth": 9, "span": 4}, "details": {"min_area": 4, "min_ratio": 0.4, "min_detail": 2}}


#: The segmentation on pictures without their text, and the colours of the text's boxes before it went.
ERASED = ERASE + FRAGMENT + ", ds0 AS (SELECT px0.*, " + " + ".join(f"({c} - bg_{c}) * ({c} - bg_{c})" for c in "rgb") + " AS d2 FROM px0 JOIN bg2 USING (image_id))" + OCR_LINES + """, mt AS (SELECT bg2.image_id, printf('#%02x%02x%02x', bg_r, bg_g, bg_b) AS background_color, 1 AS ocr_lines, 1 AS editable_text_lines, coalesce(n, 0) AS raster_layers, coalesce(fp, 0) AS foreground_pixels, coalesce(rc, 0) AS raw_components
FROM bg2 LEFT JOIN (SELECT image_id, count(*) AS n FROM la GROUP BY image_id) USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS fp FROM m GROUP BY image_id) USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS rc FROM co GROUP BY image_id) USING (image_id)),
al AS (SELECT image_id, 'raster' AS kind, layer_id, CAST(NULL AS VARCHAR) AS text, x, y, width, height, row_number() OVER (PARTITION BY image_id ORDER BY width * height DESC, y DESC, x DESC, layer_id) AS z FROM la
UNION ALL SELECT ol.image_id, 'text', 'text_001', ol.text, greatest(0, ol.x - 2), greatest(0, ol.y - 2), least(8, ol.x + ol.width + 2) - greatest(0, ol.x - 2), least(8, ol.y + ol.height + 2) - greatest(0, ol.y - 2), coalesce(n, 0) + 1 FROM ol LEFT JOIN (SELECT image_id, count(*) AS n FROM la GROUP BY image_id) USING (image_id))"""


@query(sql(ERASED, "SELECT * FROM al JOIN mt USING (image_id)", PIXELS.replace("px AS", "px0 AS")))
def lyr_9_image_to_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fragments of one line merged, text painted over, segmentation, text layers on top, and what is known of the image."""
    fragments = words(spark, sf_dir).withColumn("line_no", F.col("word_no"))
    found = image_to_layers(images(spark, sf_dir), fragments, SIDE, SIDE, SMALL, "all")
    return found.layers.join(found.metadata, "image_id")


RENDER = LAYERS + """, tc AS (SELECT lab.image_id, lab.y, lab.x_start, lab.x_end FROM lab JOIN top USING (image_id, component_id) WHERE index <= 4),
ac AS (SELECT ds.image_id, ds.y, ds.x, CAST(floor(least(255.0, greatest(0.0, (sqrt(d2) - 4) / 51 * 255))) AS BIGINT) AS a FROM ds JOIN tc ON tc.image_id = ds.image_id AND tc.y = ds.y AND ds.x BETWEEN x_start AND x_end WHERE d2 > 576),
rd AS (SELECT ds.image_id, ds.y, ds.x, """ + ", ".join(f"CAST(round_even(bg_{c} + ({c} - bg_{c}) * coalesce(a, 0) / 255.0::DOUBLE, 0) AS BIGINT) AS {c}" for c in "rgb") + " FROM ds JOIN bg USING (image_id) LEFT JOIN ac USING (image_id, y, x))"
RENDER = RENDER.replace("JOIN bg ", "JOIN bg2 ")


@query(sql(BEST + BG2 + RENDER[len(CORNER) :] + F1 + DIFF, """SELECT image_id, round(mae, 6) AS mae, round(f, 6) AS edge_f1, coalesce(n, 0) AS raster_layers, coalesce(round(largest, 6), 1) AS largest_layer_ratio, 0 AS internal_detail_layers
FROM df JOIN f2 USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS n, max(width * height) / 64.0::DOUBLE AS largest FROM la GROUP BY image_id) USING (image_id)"""))
def evl_3_candidate_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers, the slide they make, and its distance from the image."""
    px = images(spark, sf_dir)
    row = candidate_row(px, SIDE, SIDE, extract(px, SIDE, SIDE, SMALL))
    return row.withColumns({c: F.round(c, 6) for c in ("mae", "edge_f1", "largest_layer_ratio")})


def small_candidates() -> list[Candidate]:
    """The candidates of a race by their thresholds and opacities, with gates that images of this size pass."""
    out = []
    for name, mode, compact in selection.SPECS:
        o = preset(mode, compact)
        out.append(Candidate(name, replace(o, min_area_px=3 if compact else 2, min_bbox_px=1, max_layers=o.max_layers // 100 + 1, crop_padding_px=1, dilation_px=min(1, o.dilation_px))))
    return out


def cases_sql(candidates: list[Candidate]) -> str:
    """CTEs sp (the candidates), lz (layers of each case, whose image_id is n times the image's, plus the candidate's place) and ce (their pixels)."""
    n = len(candidates)
    p, d = GATES["partition"], GATES["details"]
    own = lambda o: (o.bg_threshold ** 2, "NULL" if o.surface_threshold is None else o.surface_threshold ** 2, o.min_area_px, o.max_layers, o.dilation_px, o.alpha_low, o.alpha_high, str(o.partition).lower(), str(o.internal_details).lower())
    specs = ", ".join(f"({i}, '{c.name}', {', '.join(map(str, own(c.options)))})" for i, c in enumerate(candidates))
    islands = lambda keys, source: f"SELECT {keys}, y, min(x) AS x_start, max(x) AS x_end FROM (SELECT {keys}, y, x, x - row_number() OVER (PARTITION BY {keys}, y ORDER BY x) AS island FROM {source}) GROUP BY {keys}, y, island"
    box = "CAST(sum(x_end - x_start + 1) AS BIGINT) AS area, min(x_start) AS x, min(y) AS y, max(x_end) - min(x_start) + 1 AS width, max(y) - min(y) + 1 AS height, min(y) AS first_y, arg_min(x_start, run_id) AS first_x"
    closure = lambda name, keys: f"""{name}e AS (SELECT a.image_id, a.run_id AS a, b.run_id AS b FROM {name} a JOIN {name} b ON {' AND '.join(f'a.{k} = b.{k}' for k in keys)} AND abs(a.y - b.y) = 1 AND b.x_start <= a.x_end + 1 AND b.x_end >= a.x_start - 1),
{name}w AS (SELECT image_id, run_id AS a, run_id AS b FROM {name} UNION SELECT w.image_id, w.a, e.b FROM {name}w w JOIN {name}e e ON e.image_id = w.image_id AND e.a = w.b),
{name}l AS (SELECT r.*, label FROM {name} r JOIN (SELECT image_id, a AS run_id, min(b) AS label FROM {name}w GROUP BY ALL) USING (image_id, run_id))"""  # noqa: E731
    rank = "row_number() OVER (PARTITION BY image_id ORDER BY width * height DESC, area DESC, first_y, first_x)"
    padded = "greatest(0, x - 1) AS x, greatest(0, y - 1) AS y, least(8, x + width + 1) - greatest(0, x - 1) AS width, least(8, y + height + 1) - greatest(0, y - 1) AS height"
    return f"""{BEST}{BG2}{DIST[DIST.index(', ds AS'):].replace('JOIN bg ', 'JOIN bg2 ')}, sp(ord, name, bgt, sft, min_area, most, dil, lo, hi, part, det) AS (VALUES {specs}),
mk AS (SELECT image_id * {n} + ord AS image_id, ord, y, x, r, g, b, CAST(floor(least(255.0, greatest(0.0, (sqrt(d2) - lo) / (hi - lo) * 255))) AS BIGINT) AS a, dil FROM ds JOIN sp ON d2 > bgt),
m AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM mk, range(-1, 2) p(dy), range(-1, 2) q(dx) WHERE abs(dy) <= dil AND abs(dx) <= dil AND y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7),
ms AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM mk, range(-1, 2) p(dy), range(-1, 2) q(dx) WHERE abs(dy) <= greatest(1, dil) AND abs(dx) <= greatest(1, dil)){COMPS[len(MASK):]},
tp AS (SELECT * FROM (SELECT co.*, {rank} AS index, most, part FROM co JOIN sp ON sp.ord = co.image_id % {n} WHERE area >= min_area) WHERE index <= most),
kc AS (SELECT lab.image_id, lab.component_id, lab.y, unnest(range(x_start, x_end + 1)) AS x FROM lab JOIN tp USING (image_id, component_id) WHERE part),
{cuts_sql("image_id, component_id", "SELECT * FROM kc", f"SELECT * FROM tp WHERE part AND greatest(width, height) >= {p['span']} AND area >= {p['area']}", p)},
pc AS (SELECT image_id, component_id, region, y, x FROM rc UNION ALL SELECT image_id, component_id, 1, y, x FROM kc WHERE NOT EXISTS (SELECT 1 FROM leaf l WHERE l.image_id = kc.image_id AND l.component_id = kc.component_id)),
pr0 AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY component_id, region, y, x_start) AS run_id FROM ({islands('image_id, component_id, region', 'pc')})),
{closure('pr0', ['image_id', 'component_id', 'region'])},
pb AS (SELECT image_id, label AS component_id, {box} FROM pr0l GROUP BY image_id, label),
pt AS (SELECT pb.*, {rank} AS index FROM pb),
tq AS (SELECT image_id, component_id, area, x, y, width, height, index FROM tp WHERE NOT part UNION ALL SELECT image_id, component_id, area, x, y, width, height, index FROM pt JOIN sp ON sp.ord = image_id % {n} WHERE index <= most),
fl AS (SELECT image_id, component_id, y, x_start, x_end FROM lab JOIN sp ON sp.ord = image_id % {n} WHERE NOT part UNION ALL SELECT image_id, label, y, x_start, x_end FROM pr0l),
fx AS (SELECT image_id, component_id, y, unnest(range(x_start, x_end + 1)) AS x FROM fl),
sh AS (SELECT fx.image_id, fx.component_id, index, fx.y, fx.x, r, g, b, a FROM fx JOIN mk USING (image_id, y, x) JOIN tq ON tq.image_id = fx.image_id AND tq.component_id = fx.component_id WHERE a > 0),
tr AS (SELECT * FROM tq SEMI JOIN sh USING (image_id, component_id)),
dc0 AS (SELECT fx.image_id, fx.component_id, px.y, px.x, px.r, px.g, px.b, ((px.r // 16 * 16 + 8) << 16) | ((px.g // 16 * 16 + 8) << 8) | (px.b // 16 * 16 + 8) AS c
  FROM fx JOIN px ON px.image_id = fx.image_id // {n} AND px.y = fx.y AND px.x = fx.x JOIN sp ON sp.ord = fx.image_id % {n}
  JOIN (SELECT image_id, component_id FROM fl GROUP BY ALL HAVING sum(x_end - x_start + 1) >= {d['min_area']} AND sum(x_end - x_start + 1)::DOUBLE / ((max(x_end) - min(x_start) + 1) * (max(y) - min(y) + 1)) >= {d['min_ratio']}::DOUBLE) f ON f.image_id = fx.image_id AND f.component_id = fx.component_id WHERE det),
dm AS (SELECT image_id, component_id, arg_min(c, struct_pack(n := -n, c := c)) AS mode FROM (SELECT image_id, component_id, c, count(*) AS n FROM dc0 GROUP BY ALL) GROUP BY ALL),
dd AS (SELECT image_id, component_id, CAST(round_even(median(r), 0) AS BIGINT) AS r, CAST(round_even(median(g), 0) AS BIGINT) AS g, CAST(round_even(median(b), 0) AS BIGINT) AS b FROM dc0 JOIN dm USING (image_id, component_id) WHERE (r - (mode >> 16)) ** 2 + (g - ((mode >> 8) & 255)) ** 2 + (b - (mode & 255)) ** 2 <= 784 GROUP BY ALL),
df0 AS (SELECT image_id, component_id, coalesce(r, mode >> 16) AS r, coalesce(g, (mode >> 8) & 255) AS g, coalesce(b, mode & 255) AS b FROM dm LEFT JOIN dd USING (image_id, component_id)),
dom AS (SELECT * FROM df0 WHERE (r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) / 255 <= 0.72::DOUBLE),
fr AS (SELECT * FROM (SELECT dc0.image_id, dc0.component_id, dc0.y, dc0.x, count(*) OVER (PARTITION BY dc0.image_id, dc0.component_id) AS n FROM dc0 JOIN dom USING (image_id, component_id) WHERE (dc0.r - dom.r) ** 2 + (dc0.g - dom.g) ** 2 + (dc0.b - dom.b) ** 2 >= 2116) WHERE n >= {d['min_detail']}),
dr0 AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY component_id, y, x_start) AS run_id FROM ({islands('image_id, component_id', 'fr')})),
{closure('dr0', ['image_id', 'component_id'])},
db AS (SELECT image_id, component_id, label, {box} FROM dr0l GROUP BY image_id, component_id, label HAVING sum(x_end - x_start + 1) >= {d['min_detail']}),
dn AS (SELECT *, row_number() OVER (PARTITION BY image_id, component_id ORDER BY width * height DESC, area DESC, first_y, first_x) AS detail FROM db),
dx AS (SELECT l.image_id, l.component_id, l.label, sh.index, sh.y, sh.x, sh.r, sh.g, sh.b, sh.a FROM (SELECT image_id, component_id, label, y, unnest(range(x_start, x_end + 1)) AS x FROM dr0l) l JOIN sh USING (image_id, component_id, y, x)),
dl AS (SELECT dn.*, index FROM dn JOIN (SELECT DISTINCT image_id, component_id, label, index FROM dx) USING (image_id, component_id, label)),
ba AS (SELECT dom.* FROM dom SEMI JOIN fr USING (image_id, component_id)),
su0 AS (SELECT image_id * {n} + ord AS image_id, y, x, r, g, b FROM ds JOIN sp ON d2 > sft WHERE sft < bgt),
su1 AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n FROM su0 ANTI JOIN ms USING (image_id, y, x)),
su AS (SELECT * FROM su1 WHERE n >= {GATES['surface_least']}),
la AS (SELECT tr.image_id, printf('raster_%03d', index) || CASE WHEN ba.r IS NOT NULL THEN '_base' ELSE '' END AS layer_id, area, {padded} FROM tr LEFT JOIN ba USING (image_id, component_id)
  UNION ALL SELECT image_id, printf('raster_%03d_detail_%03d', index, detail), area, {padded} FROM dl
  UNION ALL SELECT image_id, 'surface_001', area, {padded} FROM (SELECT image_id, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM su GROUP BY image_id)),
lz AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY width * height DESC, y DESC, x DESC, layer_id) AS z FROM la),
ce AS (SELECT sh.image_id, printf('raster_%03d', sh.index) || CASE WHEN ba.r IS NOT NULL THEN '_base' ELSE '' END AS layer_id, sh.y, sh.x, CASE WHEN fr.x IS NOT NULL THEN ba.r ELSE sh.r END AS r, CASE WHEN fr.x IS NOT NULL THEN ba.g ELSE sh.g END AS g, CASE WHEN fr.x IS NOT NULL THEN ba.b ELSE sh.b END AS b, sh.a
  FROM sh LEFT JOIN ba USING (image_id, component_id) LEFT JOIN fr ON fr.image_id = sh.image_id AND fr.component_id = sh.component_id AND fr.y = sh.y AND fr.x = sh.x
  UNION ALL SELECT image_id, printf('raster_%03d_detail_%03d', dx.index, detail), dx.y, dx.x, r, g, b, a FROM dx JOIN dl USING (image_id, component_id, label)
  UNION ALL SELECT image_id, 'surface_001', y, x, r, g, b, 255 FROM su)"""


def race_sql() -> str:
    """CTEs up to cs: a row for each candidate of each image with the metrics of its layers and its score."""
    candidates = small_candidates()
    n = len(candidates)
    over = ", ".join(f"CAST(round_even(list_reduce(list_prepend({{'v': bg_{c}::DOUBLE, 'a': 0::DOUBLE}}, list({{'v': {c}::DOUBLE, 'a': a::DOUBLE}} ORDER BY z)), lambda o, s: {{'v': o.v + (s.v - o.v) * s.a / 255.0::DOUBLE, 'a': 0::DOUBLE}}).v, 0) AS BIGINT) AS {c}" for c in "rgb")
    return f"""{cases_sql(candidates)},
st AS (SELECT image_id, ce.y, ce.x, {over} FROM ce JOIN lz USING (image_id, layer_id) JOIN (SELECT image_id * {n} + ord AS image_id, bg_r, bg_g, bg_b FROM bg2, sp) USING (image_id) GROUP BY image_id, ce.y, ce.x, bg_r, bg_g, bg_b),
cx AS (SELECT image_id * {n} + ord AS image_id, y, x, r, g, b FROM px, sp),
rd AS (SELECT cx.image_id, cx.y, cx.x, coalesce(st.r, bg_r) AS r, coalesce(st.g, bg_g) AS g, coalesce(st.b, bg_b) AS b FROM cx JOIN bg2 ON bg2.image_id = cx.image_id // {n} LEFT JOIN st ON st.image_id = cx.image_id AND st.y = cx.y AND st.x = cx.x)
{F1.replace(' px', ' cx')}{DIFF.replace('px', 'cx').replace(' pr ', ' pp ')},
lf AS (SELECT image_id, count(*) AS n, max(width * height) / 64.0::DOUBLE AS largest, count(*) FILTER (contains(layer_id, '_detail_')) AS details FROM la GROUP BY image_id),
c AS (SELECT image_id // {n} AS image_id, image_id % {n} AS ord, mae, f AS edge_f1, coalesce(n, 0) AS raster_layers, coalesce(largest, 1) AS largest_layer_ratio, coalesce(details, 0) AS internal_detail_layers FROM df JOIN f2 USING (image_id) LEFT JOIN lf USING (image_id)){SCORED[SCORED.index(', sc AS'):].replace(' sc AS', ' cs AS').replace('FROM sc)', 'FROM cs)')}"""


@query(sql(cases_sql([Candidate("", HEAVY)]), "SELECT image_id, layer_id, CAST(area AS BIGINT) AS area, x, y, width, height, z FROM lz"))
def lyr_9_heavy_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of the segmentation at once."""
    return extract_layers(images(spark, sf_dir), SIDE, SIDE, HEAVY, **GATES)


@query(sql(race_sql() + f""", {VOTES}, ta AS (SELECT image_id, winner_index AS ord, count(*) AS votes, min(model_ord) AS first_vote FROM v WHERE ok GROUP BY ALL), tv AS (SELECT ta.* FROM ta SEMI JOIN c USING (image_id, ord)),
w AS (SELECT tv.image_id, tv.ord, votes, row_number() OVER (PARTITION BY tv.image_id ORDER BY votes DESC, tv.ord = bl.ord DESC, first_vote) AS n FROM tv JOIN bl ON bl.image_id = tv.image_id),
ch AS (SELECT bl.image_id, coalesce(w.ord, bl.ord) AS ord, coalesce(votes, 0) AS votes FROM bl LEFT JOIN w ON w.image_id = bl.image_id AND n = 1)""", """SELECT ch.image_id, ch.ord, name, CASE WHEN EXISTS (SELECT 1 FROM v WHERE ok AND v.image_id = ch.image_id) THEN 'judges' ELSE 'local_score' END AS selected_by, votes,
round(local_score, 6) AS local_score, round(mae, 6) AS mae, round(edge_f1, 6) AS edge_f1, raster_layers, round(largest_layer_ratio, 6) AS largest_layer_ratio, internal_detail_layers
FROM ch JOIN cs ON cs.image_id = ch.image_id AND cs.ord = ch.ord JOIN sp ON sp.ord = ch.ord"""))
def evl_4_preset_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image with each of the five candidates; the one that its judges choose, or else the local score."""
    won = race(images(spark, sf_dir), SIDE, SIDE, small_candidates(), votes(spark, sf_dir), **GATES)
    return won.withColumns({c: F.round(c, 6) for c in ("local_score", "mae", "edge_f1", "largest_layer_ratio")})
