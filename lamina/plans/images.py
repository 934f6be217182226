"""Queries on images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import background as bg
from lamina.operators import components as cc
from lamina.operators import metrics, pixels
from lamina.plans.registry import query
from lamina.sources import derived
from lamina.sources.derived import PIXELS, RENDERS, SIDE

THRESHOLD = 24

CORNER = ", bg AS (SELECT image_id, CAST(round_even(median(r), 0) AS BIGINT) AS bg_r, CAST(round_even(median(g), 0) AS BIGINT) AS bg_g, CAST(round_even(median(b), 0) AS BIGINT) AS bg_b FROM px GROUP BY image_id)"
DIST = CORNER + ", ds AS (SELECT px.*, (r - bg_r) * (r - bg_r) + (g - bg_g) * (g - bg_g) + (b - bg_b) * (b - bg_b) AS d2 FROM px JOIN bg USING (image_id))"
MASK = DIST + ", m AS (SELECT * FROM ds WHERE d2 > 576)"
RUNS = MASK + """, i0 AS (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS island FROM m),
r0 AS (SELECT image_id, y, min(x) AS x_start, max(x) AS x_end FROM i0 GROUP BY image_id, y, island),
runs AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x_start) AS run_id FROM r0)"""
EDGES = RUNS + """, edges AS (SELECT a.image_id, a.run_id AS a, b.run_id AS b FROM runs a JOIN runs b ON a.image_id = b.image_id AND b.y = a.y - 1 AND b.x_start <= a.x_end + 1 AND b.x_end >= a.x_start - 1)"""
LABELS = EDGES + """, both_ways AS (SELECT image_id, a, b FROM edges UNION ALL SELECT image_id, b, a FROM edges),
reach AS (SELECT image_id, run_id AS a, run_id AS b FROM runs UNION SELECT reach.image_id, reach.a, w.b FROM reach JOIN both_ways w ON w.image_id = reach.image_id AND w.a = reach.b),
lab AS (SELECT runs.*, component_id FROM runs JOIN (SELECT image_id, a AS run_id, min(b) AS component_id FROM reach GROUP BY image_id, a) USING (image_id, run_id))"""
COMPS = LABELS + """, co AS (SELECT image_id, component_id, CAST(sum(x_end - x_start + 1) AS BIGINT) AS area, min(x_start) AS x, min(y) AS y, max(x_end) - min(x_start) + 1 AS width, max(y) - min(y) + 1 AS height,
min(y) AS first_y, arg_min(x_start, run_id) AS first_x FROM lab GROUP BY image_id, component_id)"""
TOP = COMPS + """, top AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY width * height DESC, area DESC, first_y, first_x) AS index FROM co WHERE area >= 2 AND width >= 1 AND height >= 1)"""
LAYERS = TOP + """, pd AS (SELECT image_id, index, area, greatest(0, x - 1) AS px, greatest(0, y - 1) AS py, least(8, x + width + 1) AS pr, least(8, y + height + 1) AS pb FROM top WHERE index <= 4),
la AS (SELECT image_id, 'raster_' || printf('%03d', index) AS layer_id, area, px AS x, py AS y, pr - px AS width, pb - py AS height FROM pd)"""


def sql(fragment: str, last: str, base: str = PIXELS) -> str:
    return f"WITH RECURSIVE {base}{fragment} {last}"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.pixels(spark, sf_dir)


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = images(spark, sf_dir)
    return pixels.with_distance(px, bg.corner_background(px, SIDE, SIDE))


def mask(spark: SparkSession, sf_dir: str, threshold: int = THRESHOLD) -> DataFrame:
    return pixels.foreground(distances(spark, sf_dir), threshold)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.labelled(cc.runs(mask(spark, sf_dir)))


def top_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.largest(cc.components(labelled(spark, sf_dir)), 2, 1, 4)


@query(sql(LAYERS, "SELECT image_id, layer_id, area, x, y, width, height, row_number() OVER (PARTITION BY image_id ORDER BY width * height DESC, y DESC, x DESC, layer_id) AS z FROM la"))
def component_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.layers(top_layers(spark, sf_dir), 1, SIDE, SIDE)


@query(sql(DIST, "SELECT image_id, y, x, d2 FROM ds"))
def prj_1_squared_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances(spark, sf_dir).select("image_id", "y", "x", "d2")


BOXES = ", tb AS (SELECT DISTINCT image_id, image_id % 5 AS l, image_id % 3 AS t, image_id % 5 + 1 + image_id % 3 AS r, image_id % 3 + 2 AS b FROM px)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("image_id")
    ids = derived.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"))
    return ids.select("image_id", (i % 5).alias("left"), (i % 3).alias("top"), (i % 5 + 1 + i % 3).alias("right"), (i % 3 + 2).alias("bottom"))


@query(sql(MASK + BOXES, "SELECT m.image_id, m.y, m.x FROM m WHERE NOT EXISTS (SELECT 1 FROM tb WHERE tb.image_id = m.image_id AND m.x >= tb.l AND m.x < tb.r AND m.y >= tb.t AND m.y < tb.b)"))
def prj_2_foreground_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.foreground(distances(spark, sf_dir), THRESHOLD, boxes(spark, sf_dir)).select("image_id", "y", "x")


@query(sql(DIST, "SELECT image_id, y, x, CAST(floor(least(255.0, greatest(0.0, (sqrt(d2) - 12) / 58 * 255))) AS BIGINT) AS alpha FROM ds"))
def prj_3_alpha_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances(spark, sf_dir).select("image_id", "y", "x", pixels.alpha(F.col("d2"), 12, 70).alias("alpha"))


@query(sql("", "SELECT image_id, y, x, c AS colour, c >> 16 AS qr, (c >> 8) & 255 AS qg, c & 255 AS qb FROM (SELECT image_id, y, x, ((r // 16 * 16 + 8) << 16) | ((g // 16 * 16 + 8) << 8) | (b // 16 * 16 + 8) AS c FROM px)"))
def prj_4_quantised_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = images(spark, sf_dir).select("image_id", "y", "x", pixels.quantised(F.col("r"), F.col("g"), F.col("b")).alias("colour"))
    return c.select("*", *[v.alias(k) for k, v in zip(("qr", "qg", "qb"), pixels.unpacked(F.col("colour")), strict=True)])


@query(sql("", "SELECT image_id, y, x, round((r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) / 255, 6) AS luma, greatest(r, g, b) - least(r, g, b) AS saturation FROM px"))
def prj_6_luma_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(x) for x in "rgb"]
    return images(spark, sf_dir).select("image_id", "y", "x", F.round(pixels.luma(*c), 6).alias("luma"), pixels.saturation(*c).alias("saturation"))


@query(sql(BOXES, "SELECT px.image_id, px.y, px.x FROM px WHERE EXISTS (SELECT 1 FROM tb WHERE tb.image_id = px.image_id AND px.x >= tb.l AND px.x < tb.r AND px.y >= tb.t AND px.y < tb.b)"))
def prj_9_text_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.text_mask(images(spark, sf_dir), boxes(spark, sf_dir))


@query(sql(TOP, "SELECT image_id, component_id, index, area FROM top WHERE index <= 4"))
def srt_1_largest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_layers(spark, sf_dir).select("image_id", "component_id", "index", "area")


@query(sql(RUNS, "SELECT image_id, y, x_start, x_end, run_id FROM runs"))
def win_1_row_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.runs(mask(spark, sf_dir)).select("image_id", "y", "x_start", "x_end", "run_id")


@query(sql(EDGES, "SELECT * FROM edges"))
def jon_1_run_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.run_edges(cc.runs(mask(spark, sf_dir)))


@query(sql(LABELS, "SELECT image_id, run_id, component_id FROM lab"))
def gra_2_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("image_id", "run_id", "component_id")


@query(sql(COMPS, "SELECT * FROM co"))
def agg_1_component_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.components(labelled(spark, sf_dir))


@query(sql(COMPS, "SELECT image_id, CAST(sum(area) AS BIGINT) AS foreground_pixels, count(*) AS raw_components, count(*) FILTER (area >= 2) AS emitted_components FROM co GROUP BY image_id"))
def agg_2_image_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.components(labelled(spark, sf_dir)).groupBy("image_id").agg(F.sum("area").alias("foreground_pixels"), F.count("*").alias("raw_components"), F.count_if(F.col("area") >= 2).alias("emitted_components"))


Q = ", q AS (SELECT *, ((r // 16 * 16 + 8) << 16) | ((g // 16 * 16 + 8) << 8) | (b // 16 * 16 + 8) AS c FROM px)"


@query(sql(Q, "SELECT image_id, colour, n, rank FROM (SELECT image_id, c AS colour, count(*) AS n, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, c DESC) AS rank FROM q GROUP BY image_id, c) WHERE rank <= 12"))
def agg_3_top_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bg.top_colours(images(spark, sf_dir), 12)


DOM = Q + """, cn AS (SELECT image_id, c, count(*) AS n FROM q GROUP BY image_id, c), mo AS (SELECT image_id, arg_min(c, struct_pack(a := -n, b := c)) AS mode FROM cn GROUP BY image_id),
nr AS (SELECT px.* FROM px JOIN mo USING (image_id) WHERE (r - (mode >> 16)) ** 2 + (g - ((mode >> 8) & 255)) ** 2 + (b - (mode & 255)) ** 2 <= 784),
md AS (SELECT image_id, CAST(round_even(median(r), 0) AS BIGINT) AS r, CAST(round_even(median(g), 0) AS BIGINT) AS g, CAST(round_even(median(b), 0) AS BIGINT) AS b FROM nr GROUP BY image_id)"""


@query(sql(DOM, "SELECT image_id, coalesce(r, mode >> 16) AS r, coalesce(g, (mode >> 8) & 255) AS g, coalesce(b, mode & 255) AS b FROM mo LEFT JOIN md USING (image_id)"))
def agg_4_dominant_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bg.dominant_colours(images(spark, sf_dir), "image_id")


@query(sql(CORNER, "SELECT * FROM bg"))
def agg_5_corner_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bg.corner_background(images(spark, sf_dir), SIDE, SIDE)


CANDS = CORNER + Q + """, bd AS (SELECT * FROM q WHERE y < 2 UNION ALL SELECT * FROM q WHERE y >= 6 UNION ALL SELECT * FROM q WHERE x < 2 UNION ALL SELECT * FROM q WHERE x >= 6),
t1 AS (SELECT image_id, c, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, c DESC) AS ord FROM q GROUP BY image_id, c),
t2 AS (SELECT image_id, c, 12 + row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, c DESC) AS ord FROM bd GROUP BY image_id, c),
ca AS (SELECT image_id, bg_r AS cr, bg_g AS cg, bg_b AS cb, 0 AS ord FROM bg UNION ALL SELECT image_id, c >> 16, (c >> 8) & 255, c & 255, ord FROM (SELECT * FROM t1 WHERE ord <= 12 UNION ALL SELECT * FROM t2 WHERE ord <= 20)),
cd AS (SELECT image_id, cr, cg, cb, min(ord) AS ord FROM ca GROUP BY ALL),
cv AS (SELECT image_id, ord, avg(CASE WHEN (r - cr) ** 2 + (g - cg) ** 2 + (b - cb) ** 2 <= 900 THEN 1.0::DOUBLE ELSE 0 END) AS coverage FROM cd JOIN px USING (image_id) GROUP BY ALL),
cb2 AS (SELECT image_id, ord, avg(CASE WHEN (r - cr) ** 2 + (g - cg) ** 2 + (b - cb) ** 2 <= 900 THEN 1.0::DOUBLE ELSE 0 END) AS border_coverage FROM cd JOIN bd USING (image_id) GROUP BY ALL),
sc AS (SELECT cd.*, coverage, border_coverage, (cr * 0.2126::DOUBLE + cg * 0.7152::DOUBLE + cb * 0.0722::DOUBLE) / 255.0::DOUBLE AS luma FROM cd JOIN cv USING (image_id, ord) JOIN cb2 USING (image_id, ord))"""


@query(sql(CANDS, "SELECT image_id, cr AS r, cg AS g, cb AS b, ord, round(coverage, 6) AS coverage, round(border_coverage, 6) AS border_coverage, round(luma, 6) AS luma FROM sc"))
def agg_6_background_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bg.scored_candidates(images(spark, sf_dir), SIDE, SIDE)
    return c.select("image_id", "r", "g", "b", "ord", *[F.round(x, 6).alias(x) for x in ("coverage", "border_coverage", "luma")])


BEST = CANDS + """, be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY coverage DESC, border_coverage DESC, luma DESC, ord) AS k FROM sc) WHERE k = 1),
rf AS (SELECT image_id, CAST(round_even(median(r), 0) AS BIGINT) AS r, CAST(round_even(median(g), 0) AS BIGINT) AS g, CAST(round_even(median(b), 0) AS BIGINT) AS b FROM px JOIN be USING (image_id) WHERE (r - cr) ** 2 + (g - cg) ** 2 + (b - cb) ** 2 <= 900 GROUP BY image_id)"""


@query(sql(BEST, "SELECT image_id, coalesce(r, cr) AS bg_r, coalesce(g, cg) AS bg_g, coalesce(b, cb) AS bg_b FROM be LEFT JOIN rf USING (image_id)"))
def agg_8_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bg.background(images(spark, sf_dir), SIDE, SIDE)


@query(sql(MASK, "SELECT image_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM m GROUP BY image_id"))
def agg_9_mask_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(spark, sf_dir).groupBy("image_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))


DENSITY = MASK + """, im AS (SELECT DISTINCT image_id FROM m), dx AS (SELECT im.image_id, a AS pos, count(m.x) / 8.0::DOUBLE AS density FROM im CROSS JOIN range(8) t(a) LEFT JOIN m ON m.image_id = im.image_id AND m.x = a GROUP BY ALL),
dy AS (SELECT im.image_id, a AS pos, count(m.y) / 8.0::DOUBLE AS density FROM im CROSS JOIN range(8) t(a) LEFT JOIN m ON m.image_id = im.image_id AND m.y = a GROUP BY ALL)"""


@query(sql(DENSITY, "SELECT 'x' AS axis, image_id, pos, density FROM dx UNION ALL SELECT 'y', * FROM dy"))
def agg_10_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mask(spark, sf_dir)
    return cc.densities(m, "x", SIDE, SIDE).select(F.lit("x").alias("axis"), "*").unionByName(cc.densities(m, "y", SIDE, SIDE).select(F.lit("y").alias("axis"), "*"))


SPARSE = DENSITY + """, s0 AS (SELECT 1 AS axis, * FROM dx UNION ALL SELECT 0, * FROM dy),
s1 AS (SELECT *, pos - row_number() OVER (PARTITION BY axis, image_id ORDER BY pos) AS island FROM s0 WHERE density <= 0.25),
s2 AS (SELECT axis, image_id, min(pos) AS start, max(pos) + 1 AS stop FROM s1 GROUP BY axis, image_id, island),
s3 AS (SELECT *, row_number() OVER (PARTITION BY axis, image_id ORDER BY stop - start DESC, start) AS k FROM s2 WHERE stop - start >= 2)"""


@query(sql(SPARSE, "SELECT image_id, start, stop AS \"end\" FROM s3 WHERE axis = 1 AND k = 1"))
def win_4_longest_sparse_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.longest_sparse_run(cc.densities(mask(spark, sf_dir), "x", SIDE, SIDE), 0.25, 2)


@query(sql(SPARSE, "SELECT image_id, share, axis, pos FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY share DESC, axis DESC, pos DESC) AS n FROM (SELECT image_id, (stop - start) / 8.0::DOUBLE AS share, axis, (start + stop) // 2 AS pos FROM s3 WHERE k = 1) WHERE pos >= 2 AND 8 - pos >= 2) WHERE n = 1"))
def gra_5_best_sparse_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.best_sparse_split(mask(spark, sf_dir), SIDE, SIDE, 0.25, 2, 4)


@query(sql(MASK, "SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM m, range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7"))
def nbr_1_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.dilated(mask(spark, sf_dir), 1, SIDE, SIDE)


@query(sql(MASK + ", gr AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM m, range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7)", "SELECT px.image_id, px.y, px.x FROM px WHERE NOT EXISTS (SELECT 1 FROM px n WHERE n.image_id = px.image_id AND abs(n.y - px.y) <= 1 AND abs(n.x - px.x) <= 1 AND (n.image_id, n.y, n.x) NOT IN (SELECT image_id, y, x FROM gr))"))
def nbr_2_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.closed(mask(spark, sf_dir), SIDE, SIDE)


@query(sql("", "SELECT image_id, y // 2 AS y, x // 2 AS x, CAST(round_even(avg(r), 0) AS BIGINT) AS r, CAST(round_even(avg(g), 0) AS BIGINT) AS g, CAST(round_even(avg(b), 0) AS BIGINT) AS b FROM px GROUP BY ALL"))
def nbr_3_block_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.block_average(images(spark, sf_dir), 2)


def resized_sql(source: str, name: str, axis: str, size: int, to: int) -> str:
    """CTEs that resample one axis: weights as whole numbers, sums cut to bytes."""
    other = "y" if axis == "x" else "x"
    return f""", {name}f AS (SELECT p, s, (s - (p + 0.5::DOUBLE) * {size} / {to} + 0.5::DOUBLE) / greatest(1.0::DOUBLE, {size} / {to}::DOUBLE) AS d FROM range({to}) a(p), range({size}) b(s)
  WHERE s >= greatest(0, trunc((p + 0.5::DOUBLE) * {size} / {to} - 3 * greatest(1.0::DOUBLE, {size} / {to}::DOUBLE) + 0.5::DOUBLE)) AND s < least({size}, trunc((p + 0.5::DOUBLE) * {size} / {to} + 3 * greatest(1.0::DOUBLE, {size} / {to}::DOUBLE) + 0.5::DOUBLE))),
{name}w AS (SELECT p, s, CASE WHEN abs(d) < 1e-12 THEN 1.0::DOUBLE WHEN d >= -3 AND d < 3 THEN sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) ELSE 0 END AS w FROM {name}f),
{name}k AS (SELECT p, s, CAST(round(w / sum(w) OVER (PARTITION BY p) * 4194304, 0) AS BIGINT) AS k FROM {name}w),
{name} AS (SELECT image_id, {other}, p AS {axis}, """ + ", ".join(f"least(255, greatest(0, (CAST(sum({c} * k) AS BIGINT) + 2097152) >> 22)) AS {c}" for c in "rgb") + f" FROM {source} JOIN {name}k ON s = {source}.{axis} GROUP BY image_id, {other}, p)"


RESIZED = resized_sql("px", "rx", "x", 8, 12) + resized_sql("rx", "ry", "y", 8, 6)


@query(sql(RESIZED, "SELECT image_id, y, x, r, g, b FROM ry"))
def nbr_4_resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wider and lower."""
    return pixels.resized(images(spark, sf_dir), SIDE, SIDE, 12, 6)


OTHER = resized_sql("rd", "sx", "x", 8, 12) + resized_sql("sx", "sy", "y", 8, 6)


@query(sql(RESIZED + OTHER + """, pr AS (SELECT ry.image_id, ry.r, ry.g, ry.b, sy.r AS r2, sy.g AS g2, sy.b AS b2 FROM ry JOIN sy USING (image_id, y, x)),
sm AS (SELECT image_id, sum(abs(r - r2) + abs(g - g2) + abs(b - b2))::DOUBLE AS a, sum((r - r2) * (r - r2) + (g - g2) * (g - g2) + (b - b2) * (b - b2))::DOUBLE AS s, count(*) * 3 AS n FROM pr GROUP BY image_id)""", "SELECT image_id, round(a / n, 6) AS mae, round(sqrt(s / n), 6) AS rmse FROM sm", RENDERS))
def evl_2_compare_resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images are brought to the size of their renders, 12 x 6, before both are compared."""
    render = pixels.resized(derived.renders(spark, sf_dir), SIDE, SIDE, 12, 6)
    found = metrics.differences(metrics.aligned(pixels.resized(images(spark, sf_dir), SIDE, SIDE, 12, 6), render))
    return found.select("image_id", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


@query(sql(LABELS, "SELECT lab.image_id, component_id, px.y, px.x, px.r, px.g, px.b FROM lab JOIN px ON px.image_id = lab.image_id AND px.y = lab.y AND px.x BETWEEN x_start AND x_end"))
def jon_8_component_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.component_pixels(labelled(spark, sf_dir), images(spark, sf_dir)).select("image_id", "component_id", "y", "x", "r", "g", "b")


SURFACE = DIST + """, lo AS (SELECT * FROM ds WHERE d2 > 324), hi AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM ds, range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE d2 > 40000),
su AS (SELECT lo.* FROM lo ANTI JOIN hi USING (image_id, y, x))"""


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = pixels.dilated(mask(spark, sf_dir, 200), 1, SIDE, SIDE)
    return mask(spark, sf_dir, 18).join(high, pixels.PIXEL, "left_anti")


@query(sql(SURFACE, "SELECT image_id, y, x FROM su"))
def jon_7_mask_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface(spark, sf_dir).select("image_id", "y", "x")


@query(sql(SURFACE, "SELECT image_id, 'surface_001' AS layer_id, count(*) AS surface_pixels, greatest(0, min(x) - 1) AS x, greatest(0, min(y) - 1) AS y, least(8, max(x) + 2) - greatest(0, min(x) - 1) AS width, least(8, max(y) + 2) - greatest(0, min(y) - 1) AS height FROM su GROUP BY image_id HAVING count(*) >= 3"))
def lyr_2_surface_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = surface(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("surface_pixels"), F.min("x").alias("l"), F.min("y").alias("t"), F.max("x").alias("r"), F.max("y").alias("b")).where("surface_pixels >= 3")
    box = pixels.padded({"x": F.col("l"), "y": F.col("t"), "width": F.col("r") - F.col("l") + 1, "height": F.col("b") - F.col("t") + 1}, 1, F.lit(SIDE), F.lit(SIDE))
    return s.select("image_id", F.lit("surface_001").alias("layer_id"), "surface_pixels", *[v.alias(k) for k, v in box.items()])


PAIR = ", pr AS (SELECT px.image_id, px.y, px.x, px.r, px.g, px.b, rd.r AS r2, rd.g AS g2, rd.b AS b2 FROM px JOIN rd USING (image_id, y, x))"
#: The same pairs as groups of two, whose number DuckDB doesn't overrate.
GROUPED = """, sides AS (SELECT 0 AS s, * FROM px UNION ALL SELECT 1, image_id, y, x, r, g, b FROM rd),
pr AS (SELECT image_id, y, x, """ + ", ".join(f"max({c}) FILTER (s = {k}) AS {c}{n}" for k, n in ((0, ""), (1, "2")) for c in "rgb") + """ FROM sides GROUP BY image_id, y, x HAVING count(*) = 2)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.aligned(images(spark, sf_dir), derived.renders(spark, sf_dir))


@query(sql(GROUPED, "SELECT * FROM pr", RENDERS))
def jon_2_aligned_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


DIFF = PAIR + """, sm AS (SELECT image_id, sum(abs(r - r2) + abs(g - g2) + abs(b - b2))::DOUBLE AS a, sum((r - r2) * (r - r2) + (g - g2) * (g - g2) + (b - b2) * (b - b2))::DOUBLE AS s, count(*) * 3 AS n FROM pr GROUP BY image_id),
df AS (SELECT image_id, a / n AS mae, sqrt(s / n) AS rmse, CASE WHEN s = 0 THEN 99.0::DOUBLE ELSE 20 * log10(255.0::DOUBLE / sqrt(s / n)) END AS psnr FROM sm)"""


@query(sql(DIFF, "SELECT image_id, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(psnr, 6) AS psnr FROM df", RENDERS))
def agg_11_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.differences(pairs(spark, sf_dir)).select("image_id", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "psnr")])


@query(sql(GROUPED, "SELECT image_id, y, x, least(255, 4 * abs(r - r2)) AS r, least(255, 4 * abs(g - g2)) AS g, least(255, 4 * abs(b - b2)) AS b FROM pr", RENDERS))
def snk_10_amplified_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.amplified(pairs(spark, sf_dir))


def gradient_sql(source: str, name: str) -> str:
    return f""", g{name} AS (SELECT image_id, y, x, (r * 299 + g * 587 + b * 114 + 500) // 1000 AS v FROM {source}),
m{name} AS (SELECT image_id, y, x, greatest(coalesce(abs(v - lag(v) OVER (PARTITION BY image_id, y ORDER BY x)), 0), coalesce(abs(v - lag(v) OVER (PARTITION BY image_id, x ORDER BY y)), 0)) AS magnitude FROM g{name}),
b{name} AS (SELECT image_id, greatest(12.0::DOUBLE, quantile_cont(magnitude, 0.91)) AS bound FROM m{name} GROUP BY image_id),
e{name} AS (SELECT image_id, y, x FROM m{name} JOIN b{name} USING (image_id) WHERE magnitude >= bound)"""


@query(sql(gradient_sql("px", "1"), "SELECT image_id, y, x, magnitude FROM m1"))
def win_2_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gradients(metrics.grey(images(spark, sf_dir)))


@query(sql(gradient_sql("px", "1"), "SELECT * FROM e1"))
def win_3_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.edges(metrics.gradients(metrics.grey(images(spark, sf_dir))))


F1 = gradient_sql("px", "1") + gradient_sql("rd", "2") + """, fo AS (SELECT image_id, e1.image_id IS NOT NULL AS a, e2.image_id IS NOT NULL AS b FROM e1 FULL JOIN e2 USING (image_id, y, x)),
fc AS (SELECT image_id, count(*) FILTER (a AND b) AS tp, count(*) FILTER (NOT a) AS fp, count(*) FILTER (NOT b) AS fn FROM fo GROUP BY image_id),
f1 AS (SELECT image_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (SELECT DISTINCT image_id FROM px) LEFT JOIN fc USING (image_id)),
f2 AS (SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1.0::DOUBLE ELSE 2 * tp / greatest(1, 2 * tp + fp + fn)::DOUBLE END AS f FROM f1)"""


def edge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, other = images(spark, sf_dir), derived.renders(spark, sf_dir)
    edges = lambda p: metrics.edges(metrics.gradients(metrics.grey(p)))
    return metrics.edge_f1(edges(own), edges(other), derived.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id")))


@query(sql(F1, "SELECT image_id, tp, fp, fn, round(f, 6) AS edge_f1 FROM f2", RENDERS))
def agg_12_edge_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_scores(spark, sf_dir).withColumn("edge_f1", F.round("edge_f1", 6))


GRADE = "CASE WHEN s >= 92 THEN 'A' WHEN s >= 86 THEN 'B+' WHEN s >= 78 THEN 'B' WHEN s >= 68 THEN 'C' ELSE 'D' END"


@query(sql(F1 + DIFF, f"SELECT image_id, round(mae, 6) AS mae, round(f, 6) AS edge_f1, round(s, 6) AS score, {GRADE} AS grade FROM (SELECT image_id, mae, f, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 - 1.8::DOUBLE * mae + 25 * (f - 0.8::DOUBLE))) AS s FROM df JOIN f2 USING (image_id))", RENDERS))
def evl_2_compare_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = metrics.differences(pairs(spark, sf_dir)).join(edge_scores(spark, sf_dir), "image_id")
    score = metrics.quality_score(F.col("mae"), F.col("edge_f1"))
    return both.select("image_id", F.round("mae", 6).alias("mae"), F.round("edge_f1", 6).alias("edge_f1"), F.round(score, 6).alias("score"), metrics.grade(score).alias("grade"))
