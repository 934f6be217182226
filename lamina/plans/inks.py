"""Queries on text colours, details, decks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import strings
from lamina.operators import ink, selection
from lamina.operators import layers as ly
from lamina.operators import components as cc
from lamina.plans.images import BOXES, COMPS, LABELS, LAYERS, SIDE, boxes, component_layers, distances, images, labelled, mask, sql
from lamina.plans.races import TALLY, scored
from lamina.plans.registry import query
from lamina.sources import files
from lamina.sources.derived import CANDIDATES, LINES, PIXELS, VOTES, candidates, table, text_lines, votes
from lamina.sources.tables import written

LUM = "r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE AS lum, greatest(r, g, b) - least(r, g, b) AS sat"
MEDIANS = "CAST(round_even(median(r), 0) AS BIGINT) AS r, CAST(round_even(median(g), 0) AS BIGINT) AS g, CAST(round_even(median(b), 0) AS BIGINT) AS b"
INK = BOXES + f""", ib AS (SELECT px.*, {LUM.replace('r *', 'px.r *').replace('(r, g, b)', '(px.r, px.g, px.b)').replace('+ g', '+ px.g').replace('+ b', '+ px.b')} FROM px JOIN tb ON tb.image_id = px.image_id AND px.x >= tb.l AND px.x < tb.r AND px.y >= tb.t AND px.y < tb.b),
fa AS (SELECT image_id, count(*) AS n, count(*) FILTER (sat > 35) AS nc, quantile_cont(lum, 0.6) AS bound, min(lum) AS low FROM ib GROUP BY image_id)"""


@query(sql(INK, f"SELECT image_id, {MEDIANS} FROM ib JOIN fa USING (image_id) WHERE CASE WHEN nc > greatest(8, n // 12) THEN sat > 35 WHEN low < bound THEN lum < bound ELSE true END GROUP BY image_id"))
def agg_20_ink_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ink.ink_colours(ink.in_boxes(images(spark, sf_dir), boxes(spark, sf_dir), ["image_id"]), "image_id")


RING = BOXES + f""", rg0 AS (SELECT px.*, px.x >= tb.l AND px.x < tb.r AND px.y >= tb.t AND px.y < tb.b AS inside FROM px JOIN tb ON tb.image_id = px.image_id AND px.x >= tb.l - 4 AND px.x < tb.r + 4 AND px.y >= tb.t - 4 AND px.y < tb.b + 4),
rg AS (SELECT *, {LUM} FROM rg0 WHERE NOT inside), bo AS (SELECT image_id, quantile_cont(lum, 0.45) AS bound FROM rg GROUP BY image_id),
so AS (SELECT *, lum >= bound OR sat < 30 AS soft, count(*) FILTER (lum >= bound OR sat < 30) OVER (PARTITION BY image_id) AS many FROM rg JOIN bo USING (image_id)),
su AS (SELECT image_id, {MEDIANS} FROM so WHERE soft OR many < 8 GROUP BY image_id)"""


@query(sql(RING, "SELECT * FROM su"))
def agg_21_surface_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ink.surface_colours(images(spark, sf_dir), boxes(spark, sf_dir), SIDE, SIDE)


@query(sql(RING, "SELECT image_id, round(greatest(28.0::DOUBLE, least(80.0::DOUBLE, quantile_cont(sqrt((px.r - su.r) ** 2 + (px.g - su.g) ** 2 + (px.b - su.b) ** 2), 0.75) * 0.55::DOUBLE)), 6) AS threshold FROM px JOIN su USING (image_id) GROUP BY image_id"))
def agg_22_ink_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = images(spark, sf_dir)
    found = ink.ink_thresholds(ink.distances_to(px, ink.surface_colours(px, boxes(spark, sf_dir), SIDE, SIDE)), "image_id")
    return found.withColumn("threshold", F.round("threshold", 6))


CODES = "co AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, CASE WHEN event_id % 4 <> 0 THEN CASE WHEN event_id % 7 < 3 THEN 1 ELSE 0 END END AS code FROM events)"
FILLED = CODES + ", fi AS (SELECT key, pos, coalesce(last_value(code IGNORE NULLS) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS code FROM co)"
SMOOTH = FILLED + ", sm AS (SELECT key, pos, CASE WHEN count(*) OVER (PARTITION BY key) >= 9 THEN CASE WHEN avg(code) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) >= 0.5 THEN 1 ELSE 0 END ELSE code END AS code FROM fi)"


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), pos.alias("pos"), F.when(e % 4 != 0, (e % 7 < 3).cast("int")).alias("code"))


def smooth_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ink.smoothed(ink.filled_forward(codes(spark, sf_dir), "key", "pos", "code"), "key", "pos", "code")


@query(f"WITH {FILLED} SELECT * FROM fi")
def win_6_fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ink.filled_forward(codes(spark, sf_dir), "key", "pos", "code")


@query(f"WITH {SMOOTH} SELECT * FROM sm")
def win_5_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smooth_codes(spark, sf_dir)


@query(f"WITH {SMOOTH}, nw AS (SELECT *, CASE WHEN lag(code) OVER (PARTITION BY key ORDER BY pos) = code THEN 0 ELSE 1 END AS new FROM sm), nb AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY pos) AS band FROM nw) SELECT key, CAST(band AS BIGINT) AS band, min(pos) AS start, max(pos) AS \"end\", min(code) AS code FROM nb GROUP BY key, band")
def win_7_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ink.bands(smooth_codes(spark, sf_dir), "key", "pos", "code")


BANDS = SMOOTH + """, nw AS (SELECT *, CASE WHEN lag(code) OVER (PARTITION BY key ORDER BY pos) = code THEN 0 ELSE 1 END AS new FROM sm), nb AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY pos) AS band FROM nw),
bs AS (SELECT key, min(pos) AS s, max(pos) AS e, min(code) AS code FROM nb GROUP BY key, band),
ls AS (SELECT key, list(struct_pack(s := s, e := e, code := code) ORDER BY s) AS l FROM bs GROUP BY key)"""
#: One pass over the bands in order: (what is done, the place of the next band).
PASSES = f"""{BANDS}, p1 AS (SELECT key, l, 1 AS i, l[:0] AS done FROM ls UNION ALL
SELECT key, l, i + CASE WHEN l[i].e - l[i].s + 1 < 4 AND len(done) = 0 AND i < len(l) THEN 2 ELSE 1 END,
  CASE WHEN l[i].e - l[i].s + 1 >= 4 THEN list_append(done, l[i]) WHEN len(done) > 0 THEN list_append(done[:-2], struct_pack(s := done[-1].s, e := l[i].e, code := done[-1].code))
  WHEN i < len(l) THEN [struct_pack(s := l[i].s, e := l[i + 1].e, code := l[i + 1].code)] ELSE [l[i]] END FROM p1 WHERE i <= len(l)),
d1 AS (SELECT key, done AS l FROM p1 WHERE i = len(l) + 1),
d2 AS (SELECT key, CASE WHEN len(l) > 1 AND l[1].e - l[1].s + 1 < 4 THEN list_prepend(struct_pack(s := l[1].s, e := l[2].e, code := l[2].code), l[3:]) ELSE l END AS l FROM d1)"""


@query(f"WITH RECURSIVE {PASSES} SELECT key, b.s AS start, b.e AS \"end\", b.code AS code FROM (SELECT key, unnest(l) AS b FROM d2)")
def win_8_merged_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ink.merged_bands(ink.bands(smooth_codes(spark, sf_dir), "key", "pos", "code"), "key", "code", 4)


@query(sql(LABELS, "SELECT lab.image_id, component_id, count(*) FILTER (alpha > 0) AS opaque, max(alpha) AS most FROM lab JOIN (SELECT image_id, y, x, CAST(floor(least(255.0, greatest(0.0, (sqrt(d2) - 4) / 51 * 255))) AS BIGINT) AS alpha FROM m) a ON a.image_id = lab.image_id AND a.y = lab.y AND a.x BETWEEN x_start AND x_end GROUP BY ALL HAVING max(alpha) > 0"))
def lyr_3_opaque_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.opaque_components(labelled(spark, sf_dir), distances(spark, sf_dir), mask(spark, sf_dir), 4, 55)


def filled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    runs = written(labelled(spark, sf_dir))
    return runs, ly.filled_components(runs, cc.components(runs), images(spark, sf_dir), 4, 0.4, 0.72)


FULL = LABELS + """, co AS (SELECT image_id, component_id, sum(x_end - x_start + 1) AS area, (max(x_end) - min(x_start) + 1) * (max(y) - min(y) + 1) AS box FROM lab GROUP BY ALL),
fc AS (SELECT lab.image_id, lab.component_id, px.y, px.x, px.r, px.g, px.b, ((px.r // 16 * 16 + 8) << 16) | ((px.g // 16 * 16 + 8) << 8) | (px.b // 16 * 16 + 8) AS c FROM lab JOIN co USING (image_id, component_id) JOIN px ON px.image_id = lab.image_id AND px.y = lab.y AND px.x BETWEEN x_start AND x_end WHERE area >= 4 AND area::DOUBLE / greatest(1, box) >= 0.4::DOUBLE),
fm AS (SELECT image_id, component_id, arg_min(c, struct_pack(a := -n, b := c)) AS mode FROM (SELECT image_id, component_id, c, count(*) AS n FROM fc GROUP BY ALL) GROUP BY ALL),
fd AS (SELECT image_id, component_id, CAST(round_even(median(r), 0) AS BIGINT) AS r, CAST(round_even(median(g), 0) AS BIGINT) AS g, CAST(round_even(median(b), 0) AS BIGINT) AS b FROM fc JOIN fm USING (image_id, component_id) WHERE (r - (mode >> 16)) ** 2 + (g - ((mode >> 8) & 255)) ** 2 + (b - (mode & 255)) ** 2 <= 784 GROUP BY ALL),
ff AS (SELECT image_id, component_id, coalesce(r, mode >> 16) AS r, coalesce(g, (mode >> 8) & 255) AS g, coalesce(b, mode & 255) AS b FROM fm LEFT JOIN fd USING (image_id, component_id))"""


@query(sql(FULL, "SELECT * FROM ff WHERE (r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) / 255 <= 0.72::DOUBLE"))
def lyr_4_filled_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled(spark, sf_dir)[1]


MARKS = FULL + """, fa0 AS (SELECT fc.image_id, fc.component_id, fc.y, fc.x, count(*) OVER (PARTITION BY fc.image_id, fc.component_id) AS n FROM fc JOIN ff USING (image_id, component_id)
  WHERE (ff.r * 0.2126::DOUBLE + ff.g * 0.7152::DOUBLE + ff.b * 0.0722::DOUBLE) / 255 <= 0.72::DOUBLE AND (fc.r - ff.r) ** 2 + (fc.g - ff.g) ** 2 + (fc.b - ff.b) ** 2 >= 2116),
fa AS (SELECT * FROM fa0 WHERE n >= 2),
dr AS (SELECT image_id, y, min(x) AS s, max(x) AS e, min(component_id) AS owner FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS island FROM fa) GROUP BY image_id, y, island),
dn AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, s) AS id FROM dr),
de AS (SELECT a.image_id, a.id AS a, b.id AS b FROM dn a JOIN dn b ON a.image_id = b.image_id AND abs(a.y - b.y) = 1 AND b.s <= a.e + 1 AND b.e >= a.s - 1),
dw AS (SELECT image_id, id AS a, id AS b FROM dn UNION SELECT dw.image_id, dw.a, de.b FROM dw JOIN de ON de.image_id = dw.image_id AND de.a = dw.b),
dl AS (SELECT dn.*, label FROM dn JOIN (SELECT image_id, a AS id, min(b) AS label FROM dw GROUP BY ALL) USING (image_id, id)),
dc AS (SELECT image_id, label, min(owner) AS component_id, CAST(sum(e - s + 1) AS BIGINT) AS area, min(s) AS x, min(y) AS y, max(e) - min(s) + 1 AS width, max(y) - min(y) + 1 AS height, arg_min(s, id) AS first_x FROM dl GROUP BY image_id, label)"""


@query(sql(MARKS, "SELECT image_id, component_id, row_number() OVER (PARTITION BY image_id, component_id ORDER BY width * height DESC, area DESC, y, first_x) AS detail, area, x, y, width, height FROM dc WHERE area >= 2"))
def lyr_4_detail_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, full = filled(spark, sf_dir)
    return ly.detail_components(runs, full, images(spark, sf_dir), 46, 2)


def cuts_sql(keys: str, cells: str, boxes: str, gates: dict, side: int = 8) -> str:
    """CTEs cut (rectangles of components, halved again and again), leaf and rc (its cells, with region). keys: of a component; cells: keys, y, x; boxes: keys, x, y, width, height of what may be cut."""
    k, g = keys, gates
    same = " AND ".join(f"cl.{c.strip()} = r.{c.strip()}" for c in keys.split(","))
    return f"""cut AS (SELECT {k}, x AS x0, y AS y0, x + width AS x1, y + height AS y1, '' AS path FROM ({boxes}) UNION ALL
SELECT {k}, CASE WHEN half = 1 AND axis = 1 THEN x0 + mid ELSE x0 END, CASE WHEN half = 1 AND axis = 0 THEN y0 + mid ELSE y0 END, CASE WHEN half = 0 AND axis = 1 THEN x0 + mid ELSE x1 END, CASE WHEN half = 0 AND axis = 0 THEN y0 + mid ELSE y1 END, path || half
FROM (SELECT *, row_number() OVER (PARTITION BY {k}, path ORDER BY share DESC, axis DESC, mid DESC) AS first FROM (
  SELECT *, (stop - start) / size::DOUBLE AS share, (start + stop) // 2 AS mid, row_number() OVER (PARTITION BY {k}, path, axis ORDER BY stop - start DESC, start) AS longest FROM (
    SELECT {k}, x0, y0, x1, y1, path, axis, size, min(pos) AS start, max(pos) + 1 AS stop FROM (
      SELECT *, pos - row_number() OVER (PARTITION BY {k}, path, axis ORDER BY pos) AS island FROM (
        SELECT *, sum(n) OVER (PARTITION BY {k}, path, axis) AS total FROM (
          SELECT {', '.join(f'r.{c.strip()}' for c in keys.split(','))}, x0, y0, x1, y1, path, axis, CASE axis WHEN 1 THEN x1 - x0 ELSE y1 - y0 END AS size, CASE axis WHEN 1 THEN y1 - y0 ELSE x1 - x0 END AS across, pos, count(cl.x) AS n
          FROM (SELECT * FROM cut WHERE len(path) < {g['depth']} AND greatest(x1 - x0, y1 - y0) >= {g['span']}) r CROSS JOIN (VALUES (0), (1)) a(axis) CROSS JOIN range({side}) p(pos)
          LEFT JOIN ({cells}) cl ON {same} AND cl.x >= x0 AND cl.x < x1 AND cl.y >= y0 AND cl.y < y1 AND CASE axis WHEN 1 THEN cl.x - x0 ELSE cl.y - y0 END = pos
          WHERE pos < CASE axis WHEN 1 THEN x1 - x0 ELSE y1 - y0 END GROUP BY ALL))
      WHERE total >= {g['area']} AND size >= {g['span']} AND n / across::DOUBLE <= {g['density']}::DOUBLE)
    GROUP BY {k}, x0, y0, x1, y1, path, axis, size, island) WHERE stop - start >= {g['gap']})
  WHERE longest = 1 AND least(mid, size - mid) >= {g['gap']}) CROSS JOIN (VALUES (0), (1)) h(half) WHERE first = 1),
leaf AS (SELECT * FROM cut c WHERE NOT EXISTS (SELECT 1 FROM cut d WHERE {' AND '.join(f'c.{x.strip()} = d.{x.strip()}' for x in keys.split(','))} AND d.path = c.path || '0')),
rc AS (SELECT {', '.join(f'r.{c.strip()}' for c in keys.split(','))}, y, x, path, dense_rank() OVER (PARTITION BY {', '.join(f'r.{c.strip()}' for c in keys.split(','))} ORDER BY path) AS region FROM leaf r JOIN ({cells}) cl ON {same} AND cl.x >= x0 AND cl.x < x1 AND cl.y >= y0 AND cl.y < y1)"""


CELLS = "SELECT image_id, component_id, y, unnest(range(x_start, x_end + 1)) AS x FROM lab"
CUTS = COMPS + ", " + cuts_sql("image_id, component_id", CELLS, "SELECT * FROM co WHERE greatest(width, height) >= 3 AND area >= 4", {"area": 4, "density": 0.3, "gap": 1, "depth": 9, "span": 3})


@query(sql(CUTS, """SELECT image_id, component_id, region, y, min(x) AS x_start, max(x) AS x_end FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, component_id, region, y ORDER BY x) AS island FROM rc) GROUP BY image_id, component_id, region, y, island
UNION ALL SELECT image_id, component_id, 1, y, x_start, x_end FROM lab WHERE NOT EXISTS (SELECT 1 FROM leaf l WHERE l.image_id = lab.image_id AND l.component_id = lab.component_id)"""))
def gra_3_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.partition(labelled(spark, sf_dir), area=4, density=0.3, gap=1, depth=9, span=3)


#: One line after another, by the height of its middle, to the first extent that it is near to.
BASELINES = LINES + """, ft AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y + height / 2, x, line_no) AS k FROM ln),
fo AS (SELECT image_id, 0::BIGINT AS k, CAST([] AS STRUCT(l BIGINT, r BIGINT, t BIGINT, b BIGINT, h BIGINT, m BIGINT[])[]) AS gs FROM (SELECT DISTINCT image_id FROM ft) UNION ALL
SELECT image_id, k, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(gs, struct_pack(l := x::BIGINT, r := (x + width)::BIGINT, t := y::BIGINT, b := (y + height)::BIGINT, h := height::BIGINT, m := [line_no::BIGINT]))
  ELSE list_concat(list_append(gs[:hit - 1], struct_pack(l := least(gs[hit].l, x)::BIGINT, r := greatest(gs[hit].r, x + width)::BIGINT, t := least(gs[hit].t, y)::BIGINT, b := greatest(gs[hit].b, y + height)::BIGINT, h := greatest(gs[hit].h, height)::BIGINT, m := list_append(gs[hit].m, line_no::BIGINT))), gs[hit + 1:]) END
FROM (SELECT fo.image_id, ft.k, gs, x, y, width, height, line_no, list_position(list_transform(gs, lambda g: abs(y + height / 2 - (g.t + g.b) / 2) <= greatest(8, g.h * 0.33) AND CASE WHEN x >= g.r THEN x - g.r ELSE g.l - x - width END <= greatest(90, g.h * 1.5)), true) AS hit
  FROM fo JOIN ft ON ft.image_id = fo.image_id AND ft.k = fo.k + 1)),
la AS (SELECT image_id, g.m AS m, i FROM (SELECT image_id, unnest(gs) AS g, unnest(range(len(gs))) AS i FROM (SELECT image_id, arg_max(gs, k) AS gs FROM fo GROUP BY image_id))),
lm AS (SELECT image_id, i, len(m) AS parts, unnest(m) AS line_no, unnest(range(len(m))) AS nth FROM la),
lo AS (SELECT image_id, i, parts, string_agg(text, ' ' ORDER BY x, y, nth) AS text, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM lm JOIN ln USING (image_id, line_no) GROUP BY ALL)"""


@query(f"WITH RECURSIVE {BASELINES} SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY y, x, text) AS line, text, x, y, width, height, parts FROM lo")
def gra_7_merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.operators import text

    return text.merged_lines(text_lines(spark, sf_dir))


EMU = "round_even(8 / 112.0::DOUBLE * 914400, 0)"


@query(sql(LAYERS, f"SELECT image_id, layer_id, CAST({EMU} AS BIGINT) AS slide_width, CAST({EMU} AS BIGINT) AS slide_height, " + ", ".join(f"CAST(round_even({c} * least({EMU} / 8, {EMU} / 8), 0) AS BIGINT) AS {n}_emu" for c, n in (("x", "left"), ("y", "top"), ("width", "width"), ("height", "height"))) + " FROM la"))
def snk_3_slide_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = component_layers(spark, sf_dir).withColumn("image_width", F.lit(SIDE)).withColumn("image_height", F.lit(SIDE))
    return files.placed(layers, F.lit(SIDE), F.lit(SIDE)).select("image_id", "layer_id", "slide_width", "slide_height", "left_emu", "top_emu", "width_emu", "height_emu")


@query(sql(LAYERS, "SELECT image_id, count(*) AS shapes, CAST(sum(CASE WHEN layer_id LIKE 'raster%' THEN 1 ELSE 0 END) AS BIGINT) AS pictures FROM la GROUP BY image_id"))
def src_8_shape_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_layers(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("shapes"), F.count_if(F.col("layer_id").startswith("raster")).alias("pictures"))


DECKS = """d AS (SELECT p_brand AS bundle, p_partkey AS image_id, p_name AS name, 1 AS slides, p_size + p_partkey % 5 AS objects, p_size AS picture_layers, p_partkey % 5 AS text_layers,
coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(p_name, '([^/]*)/*$', 1), '^(.+)\\.[^.]+$', '\\1'), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_|_$', '', 'g'), ''), 'image') AS stem FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY name, image_id) AS place FROM d)"""


@query(f"WITH {DECKS} SELECT bundle, place, printf('%02d_', place) || stem || '_layers.pptx,' || slides || ',' || objects || ',' || picture_layers || ',' || text_layers AS line FROM k UNION ALL SELECT DISTINCT bundle, 0, 'file,slides,objects,picture_layers,text_layers' FROM d")
def snk_6_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    decks = table(spark, sf_dir, "part").select(F.col("p_brand").alias("bundle"), k.alias("image_id"), F.col("p_name").alias("name"), F.lit(1).alias("slides"), (size + k % 5).alias("objects"), size.alias("picture_layers"), (k % 5).alias("text_layers"))
    return files.manifest(decks)


@query(f"WITH {CANDIDATES} SELECT image_id, ord, '<tr><td>' || ord || '</td><td>a&amp;b</td><td>heavy@24</td><td>' || ord % 4 || '/' || coalesce(CASE WHEN ord % 3 > 0 THEN CAST(ord % 9 AS VARCHAR) END, '') || '</td><td>' || raster_layers || '</td><td>' || coalesce(printf('%.3f', mae), '') || '</td><td></td><td>' || coalesce(printf('%.3f', edge_f1), '') || '</td><td>' || CASE WHEN mae IS NOT NULL THEN '<a href=\"p' || ord || '.jpg\"><img src=\"p' || ord || '.jpg\" loading=\"lazy\"></a>' ELSE '' END || '</td></tr>' AS html FROM c")
def snk_8_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ord_ = F.col("ord")
    more = {"index": ord_, "name": F.lit("a&b"), "mode": F.lit("heavy"), "threshold": F.lit(24), "psnr": F.lit(None).cast("double"), "editable_text_lines": ord_ % 4, "ocr_lines": F.when(ord_ % 3 > 0, ord_ % 9), "preview": F.when(F.col("mae").isNotNull(), F.concat(F.lit("/previews/p"), ord_.cast("string"), F.lit(".jpg")))}
    rows = files.report_rows(candidates(spark, sf_dir).withColumns(more).withColumn("key", F.struct("image_id", "ord")).drop("image_id").withColumnRenamed("key", "image_id"))
    return rows.select("image_id.image_id", "image_id.ord", "html")


@query(f"WITH {CANDIDATES} SELECT image_id, '{{\"ord\":' || ord || CASE WHEN raster_layers % 2 = 0 THEN ',\"layers\":' || raster_layers ELSE '' END || ',\"details\":' || internal_detail_layers || '}}' AS json FROM c")
def snk_9_metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = F.col("raster_layers")
    return files.metadata_json(candidates(spark, sf_dir).select("image_id", "ord", F.when(layers % 2 == 0, layers).alias("layers"), F.col("internal_detail_layers").alias("details")))


@query(f"WITH {CANDIDATES} SELECT count(*) AS files, CAST(sum(raster_layers) AS BIGINT) AS shapes, CAST(sum(internal_detail_layers) AS BIGINT) AS details FROM c")
def agg_15_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).agg(F.count("*").alias("files"), F.sum("raster_layers").alias("shapes"), F.sum("internal_detail_layers").alias("details"))


def first_values(column: str, limit: int, separator: str) -> str:
    """Of judges that answered: distinct values in order of their first occurrence, joined."""
    return f"SELECT image_id, string_agg(x, '{separator}' ORDER BY n) AS found FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY o, x) AS n FROM (SELECT image_id, trim({column}) AS x, min(model_ord) AS o FROM v WHERE ok AND trim({column}) <> '' GROUP BY ALL)) WHERE n <= {limit} GROUP BY image_id"


ENSEMBLE = f"""{TALLY}, w AS (SELECT tv.image_id, tv.ord, votes, row_number() OVER (PARTITION BY tv.image_id ORDER BY votes DESC, tv.ord = bl.ord DESC, first_vote) AS n FROM tv JOIN bl ON bl.image_id = tv.image_id),
qu AS (SELECT image_id, round(coalesce(avg(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN quality_score > 1 THEN quality_score / 100 ELSE quality_score END))), 0), 6) AS quality, count(*) AS judges, 'ensemble:' || string_agg(model_ord, ',' ORDER BY model_ord) AS model_used FROM v WHERE ok GROUP BY image_id),
fm AS ({first_values('failure_mode', 8, ';')}), nc AS ({first_values('next_change', 4, ' | ')})"""


@query(f"WITH {ENSEMBLE} SELECT bl.image_id, coalesce(w.ord, bl.ord) AS ord, coalesce(votes, 0) AS votes, quality, judges, model_used, fm.found AS failure_modes, nc.found AS next_change FROM bl JOIN qu ON qu.image_id = bl.image_id LEFT JOIN w ON w.image_id = bl.image_id AND n = 1 LEFT JOIN fm ON fm.image_id = bl.image_id LEFT JOIN nc ON nc.image_id = bl.image_id")
def evl_5_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.ensemble(votes(spark, sf_dir), candidates(spark, sf_dir), selection.best_local(scored(spark, sf_dir)))
    return found.withColumns({"quality": F.round("quality", 6), "failure_modes": F.array_join("failure_modes", ";")})


@query(f"WITH {VOTES} SELECT image_id, arg_min(winner_index, struct_pack(a := model_ord % 2, b := model_ord)) AS winner, arg_min(model_ord, struct_pack(a := model_ord % 2, b := model_ord)) AS model FROM v WHERE ok GROUP BY image_id")
def evl_6_first_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct(F.col("model_ord") % 2, "model_ord")
    return votes(spark, sf_dir).where("ok").groupBy("image_id").agg(F.min_by("winner_index", key).alias("winner"), F.min_by("model_ord", key).alias("model"))


@query(f"WITH {CANDIDATES} SELECT image_id, ord, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY raster_layers, ord) AS n FROM c) WHERE n >= 2 AND n < 5")
def src_3_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the second on, three at most."""
    return selection.stretch(candidates(spark, sf_dir), "image_id", ["raster_layers", "ord"], 2, 3).select("image_id", "ord", "place")


@query(sql(LAYERS, "SELECT image_id, coalesce(round(max(width * height) / 64.0::DOUBLE, 6), 1) AS largest_layer_ratio, 0 AS internal_detail_layers, 0 AS internal_detail_base_layers FROM (SELECT vec_id AS image_id FROM embeddings) LEFT JOIN la USING (image_id) GROUP BY image_id"))
def agg_14_layer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"))
    return selection.layer_features(component_layers(spark, sf_dir), ids, SIDE, SIDE).withColumn("largest_layer_ratio", F.round("largest_layer_ratio", 6))


@query("SELECT page_id, 'data:image/' || CASE WHEN page_id % 3 = 0 THEN 'png' ELSE 'jpeg' END || ';base64,' || to_base64(encode(url)) AS url FROM pages")
def str_13_data_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", strings.data_url(F.col("url"), F.when(F.col("page_id") % 3 == 0, "png").otherwise("jpeg")).alias("url"))


@query("SELECT p_partkey, array_to_string(list_transform(list_filter(l, lambda v, i: list_position(l, v) = i), lambda v: CAST(v AS VARCHAR)), '|') AS thresholds FROM (SELECT p_partkey, list_transform([CAST(p_size AS VARCHAR), ' ' || CAST(p_size % 5 AS VARCHAR) || '.5 ', CAST(p_size % 7 AS VARCHAR)], lambda t: CAST(trim(t) AS DOUBLE)) AS l FROM part)")
def str_7_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    text = F.concat(s.cast("string"), F.lit(", "), (s % 5).cast("string"), F.lit(".5 ,"), (s % 7).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(strings.thresholds(text), lambda v: v.cast("string")), "|").alias("thresholds"))


@query(f"WITH {LINES} SELECT image_id, string_agg(text, ' ' ORDER BY line_no) AS text, count(*) AS lines FROM ln WHERE text <> '' GROUP BY image_id")
def str_10_joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"])
    return text_lines(spark, sf_dir).where("text <> ''").groupBy("image_id").agg(F.array_join(ordered, " ").alias("text"), F.count("*").alias("lines"))


@query("SELECT o_orderkey, CAST(n AS VARCHAR) || CASE WHEN n = 1 THEN ' image' ELSE ' images' END || ', ' || lower(trim(o_orderpriority)) AS message FROM (SELECT o_orderkey, o_orderpriority, o_orderkey % 4 AS n FROM orders)")
def str_16_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 4
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(", ", strings.counted(n, "image"), F.lower(F.trim("o_orderpriority"))).alias("message"))


BORDER = PIXELS + ", bd AS (SELECT * FROM px WHERE y < 2 UNION ALL SELECT * FROM px WHERE y >= 6 UNION ALL SELECT * FROM px WHERE x < 2 UNION ALL SELECT * FROM px WHERE x >= 6)"


@query(f"WITH {BORDER} SELECT image_id, count(*) AS n, CAST(sum(r + g + b) AS BIGINT) AS total FROM bd GROUP BY image_id")
def set_1_border_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.operators.background import border_pixels

    return border_pixels(images(spark, sf_dir), SIDE, SIDE).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("r") + F.col("g") + F.col("b")).alias("total"))
