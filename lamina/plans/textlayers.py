"""Queries on text layers, whole races, and what is left of names and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import strings
from lamina.operators import background as bg
from lamina.operators import layers as ly
from lamina.operators import pixels, selection
from lamina.operators import textlayers as tl
from lamina.plans.images import DIST, LAYERS, SIDE, component_layers, distances, images, sql
from lamina.plans.inks import LUM, MEDIANS, PASSES, SMOOTH
from lamina.plans.races import SCORED, scored
from lamina.plans.registry import query
from lamina.sources.derived import CANDIDATES, PIXELS, VOTES, table

WORDS = """wd AS (SELECT vec_id AS image_id, 0 AS line_no, k AS word_no, CASE WHEN k = 0 THEN 'Word' || (vec_id % 7) ELSE 'TEXT' END AS text,
  CASE WHEN k = 0 THEN vec_id % 3 ELSE 4 END AS x, CASE WHEN k = 0 THEN vec_id % 4 ELSE vec_id % 3 END AS y, 3 AS width, 3 + k AS height FROM embeddings, range(2) t(k))"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words on each image."""
    i, k = F.col("image_id"), F.col("word_no")
    w = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("word_no"))
    pick = lambda a, b: F.when(k == 0, a).otherwise(b)
    return w.select("image_id", F.lit(0).alias("line_no"), "word_no", pick(F.concat(F.lit("Word"), (i % 7).cast("string")), F.lit("TEXT")).alias("text"), pick(i % 3, F.lit(4)).alias("x"), pick(i % 4, i % 3).alias("y"), F.lit(3).alias("width"), (k + 3).alias("height"))


def box_sql(keys: str, source: str, pad: int) -> str:
    """Ink colours of padded boxes, and black for those without ink."""
    return f""", bx AS (SELECT *, greatest(0, x - {pad}) AS l, greatest(0, y - {pad}) AS t, least(8, x + width + {pad}) AS r0, least(8, y + height + {pad}) AS b0 FROM {source}),
ik AS (SELECT {keys}, ds.r, ds.g, ds.b, ds.r * 0.2126::DOUBLE + ds.g * 0.7152::DOUBLE + ds.b * 0.0722::DOUBLE AS lum, greatest(ds.r, ds.g, ds.b) - least(ds.r, ds.g, ds.b) AS sat FROM bx JOIN ds ON ds.image_id = bx.image_id AND ds.x >= l AND ds.x < r0 AND ds.y >= t AND ds.y < b0 WHERE d2 > 1225),
ft AS (SELECT {keys.replace('bx.', '')}, count(*) AS n, count(*) FILTER (sat > 35) AS nc, quantile_cont(lum, 0.6) AS bound, min(lum) AS low FROM ik GROUP BY ALL),
cl AS (SELECT {keys.replace('bx.', '')}, CAST(round_even(median(r), 0) AS BIGINT) AS r, CAST(round_even(median(g), 0) AS BIGINT) AS g, CAST(round_even(median(b), 0) AS BIGINT) AS b FROM ik JOIN ft USING ({keys.replace('bx.', '')}) WHERE CASE WHEN nc > greatest(8, n // 12) THEN sat > 35 WHEN low < bound THEN lum < bound ELSE true END GROUP BY ALL)"""


OCR = ", ol AS (SELECT image_id, line_no, string_agg(text, ' ' ORDER BY word_no) AS text, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, count(*) AS words FROM wd GROUP BY ALL)"


@query(sql(DIST + ", " + WORDS + OCR + box_sql("bx.image_id, bx.line_no", "ol", 2), """SELECT image_id, 'text_001' AS layer_id, text, l AS x, t AS y, r0 - l AS width, b0 - t AS height, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b,
round(greatest(5.0::DOUBLE, least(72.0::DOUBLE, height * 72.0::DOUBLE / (112.0::DOUBLE * 0.82::DOUBLE), width * 72.0::DOUBLE / (112.0::DOUBLE * 0.56::DOUBLE * greatest(1.0::DOUBLE, length(text) - 0.45::DOUBLE * (length(text) - length(replace(text, ' ', ''))))) * 0.96::DOUBLE)), 6) AS font_size, upper(text) = text OR height >= 24 AS bold, words FROM bx LEFT JOIN cl USING (image_id, line_no)"""))
def lyr_5_text_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = images(spark, sf_dir)
    found = tl.text_layers(words(spark, sf_dir), px, bg.corner_background(px, SIDE, SIDE), 35, SIDE, SIDE)
    return found.drop("runs").withColumn("font_size", F.round("font_size", 6))


@query(sql(DIST + ", " + WORDS + box_sql("bx.image_id, bx.line_no, bx.word_no", "wd", 1), "SELECT image_id, line_no, string_agg(text || CASE WHEN word_no = 0 THEN ' ' ELSE '' END || '#' || coalesce(r, 0) || '-' || coalesce(g, 0) || '-' || coalesce(b, 0), '|' ORDER BY word_no) AS runs FROM bx LEFT JOIN cl USING (image_id, line_no, word_no) GROUP BY ALL"))
def lyr_6_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = images(spark, sf_dir)
    runs = tl.word_runs(words(spark, sf_dir), px, bg.corner_background(px, SIDE, SIDE), 35, SIDE, SIDE)
    shown = F.transform("runs", lambda r: F.concat(r["text"], F.lit("#"), F.concat_ws("-", r["r"], r["g"], r["b"])))
    return runs.select("image_id", "line_no", F.array_join(shown, "|").alias("runs"))


#: Three images side by side as one, the ink of the word over it by columns, their codes, and (from PASSES on) merged bands in d2. A letter's band: the i-th one ends where its share of the width does, but a letter at least after the one before.
SPLIT = f""", p3 AS (SELECT image_id // 3 AS image_id, y, x + image_id % 3 * 8 AS x, r, g, b FROM px),
b3 AS (SELECT image_id, {', '.join(f'CAST(round_even(median({c}), 0) AS BIGINT) AS bg_{c}' for c in 'rgb')} FROM p3 WHERE x < 8 OR x >= 16 GROUP BY image_id),
k3 AS (SELECT p3.*, {LUM} FROM p3 JOIN b3 USING (image_id) WHERE (r - bg_r) ** 2 + (g - bg_g) ** 2 + (b - bg_b) ** 2 > 1225),
c3 AS (SELECT image_id, x, CASE WHEN greatest(r, g, b) - least(r, g, b) > 45 AND {LUM.split(' AS lum')[0]} > 60 THEN 1 ELSE 0 END AS code FROM (SELECT image_id, x, median(r) AS r, median(g) AS g, median(b) AS b FROM k3 GROUP BY image_id, x)),
w3 AS (SELECT image_id, min(x) AS first, max(x) AS last FROM c3 GROUP BY image_id HAVING count(*) >= 12),
e3 AS (SELECT v3.image_id AS key, v - first AS pos, code FROM (SELECT image_id, first, unnest(range(first, last + 1)) AS v FROM w3) v3 LEFT JOIN c3 ON c3.image_id = v3.image_id AND c3.x = v),
fi AS (SELECT key, pos, coalesce(last_value(code IGNORE NULLS) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS code FROM e3),
sm AS (SELECT key, pos, CASE WHEN count(*) OVER (PARTITION BY key) >= 9 THEN CASE WHEN avg(code) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) >= 0.5 THEN 1 ELSE 0 END ELSE code END AS code FROM fi){PASSES[len(SMOOTH):]},
l3 AS (SELECT key, 'Header' || key AS text, l, l[-1].e + 1 AS total FROM d2 WHERE len(list_distinct(list_transform(l, lambda v: v.code))) > 1),
q3 AS (SELECT key, text, l, total, 1 AS i, 0::BIGINT AS prev, 0 AS run, 0::BIGINT AS a, 0::BIGINT AS z, '' AS part FROM l3 UNION ALL
SELECT key, text, l, total, i + 1, CASE WHEN prev < length(text) AND stop > prev THEN stop ELSE prev END, run + CASE WHEN prev < length(text) AND stop > prev THEN 1 ELSE 0 END, l[i].s, l[i].e, CASE WHEN prev < length(text) AND stop > prev THEN substring(text, prev + 1, stop - prev) ELSE '' END
FROM (SELECT *, CASE WHEN i = len(l) THEN length(text) ELSE greatest(prev + 1, CAST(round_even((l[i].e + 1) / total::DOUBLE * length(text), 0) AS BIGINT)) END AS stop FROM q3 WHERE i <= len(l))),
r3 AS (SELECT key, run, part, a, z FROM q3 WHERE part <> ''),
i3 AS (SELECT r3.key, r3.run, k3.r, k3.g, k3.b, lum, sat FROM r3 JOIN w3 ON w3.image_id = r3.key JOIN k3 ON k3.image_id = r3.key AND k3.x BETWEEN first + a AND first + z),
f3 AS (SELECT key, run, count(*) AS n, count(*) FILTER (sat > 35) AS nc, quantile_cont(lum, 0.6) AS bound, min(lum) AS low FROM i3 GROUP BY ALL),
o3 AS (SELECT key, run, {MEDIANS} FROM i3 JOIN f3 USING (key, run) WHERE CASE WHEN nc > greatest(8, n // 12) THEN sat > 35 WHEN low < bound THEN lum < bound ELSE true END GROUP BY ALL)"""


@query(sql(SPLIT, "SELECT key AS image_id, 0 AS line_no, CAST(run AS BIGINT) AS run, part AS text, a AS start, z AS \"end\", coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM r3 LEFT JOIN o3 USING (key, run)"))
def lyr_7_split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long word over each image, on three images side by side as one, so that it has columns enough to be split.

    Ids below zero put their image left of the others, by two at most; ids are divided as whole numbers, since those beyond 2 ** 53 are no doubles.
    """
    px = images(spark, sf_dir).withColumn("x", F.col("x") + F.col("image_id") % 3 * SIDE).withColumn("image_id", F.expr("image_id div 3"))
    background, wide = bg.corner_background(px, 3 * SIDE, SIDE), 5 * SIDE
    px = px.withColumn("x", F.col("x") + 2 * SIDE)
    word = px.select("image_id").distinct().select("image_id", F.lit(0).alias("line_no"), F.lit(0).alias("word_no"), F.concat(F.lit("Header"), F.col("image_id").cast("string")).alias("text"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(wide).alias("width"), F.lit(SIDE).alias("height"))
    return tl.split_words(word, px, background, 35, wide, SIDE)


def fill_sql(word: int, source: str, to: str) -> str:
    """CTEs that paint one word of each image over: its frame, the frame's light or soft pixels, what in the box is far from their median, closed, in that median."""
    n = lambda x: f"{x}{word}"
    return f""", {n('ba')} AS (SELECT image_id, l, t, r0, b0, greatest(0, l - 4) AS ol, greatest(0, t - 4) AS ot, least(8, r0 + 4) AS orr, least(8, b0 + 4) AS ob FROM (SELECT image_id, greatest(0, x - 3) AS l, greatest(0, y - 3) AS t, least(8, x + width + 3) AS r0, least(8, y + height + 3) AS b0 FROM wd WHERE word_no = {word}) WHERE r0 - l >= 2 AND b0 - t >= 2),
{n('fa')} AS (SELECT p.*, x >= l AND x < r0 AND y >= t AND y < b0 AS inside, {LUM} FROM {source} p JOIN {n('ba')} USING (image_id) WHERE x >= ol AND x < orr AND y >= ot AND y < ob),
{n('fb')} AS (SELECT *, count(*) FILTER (NOT inside) OVER (PARTITION BY image_id) AS ring FROM {n('fa')}),
{n('fc')} AS (SELECT * FROM {n('fb')} WHERE NOT inside OR ring < 8),
{n('fd')} AS (SELECT f.*, lum >= bound OR sat < 30 AS soft, count(*) FILTER (lum >= bound OR sat < 30) OVER (PARTITION BY f.image_id) AS many FROM {n('fc')} f JOIN (SELECT image_id, quantile_cont(lum, 0.45) AS bound FROM {n('fc')} GROUP BY image_id) USING (image_id)),
{n('fe')} AS (SELECT image_id, {MEDIANS} FROM {n('fd')} WHERE soft OR many < 8 GROUP BY image_id),
{n('fg')} AS (SELECT a.image_id, y, x, sqrt((a.r - e.r) ** 2 + (a.g - e.g) ** 2 + (a.b - e.b) ** 2) AS d FROM {n('fa')} a JOIN {n('fe')} e USING (image_id) WHERE inside),
{n('fh')} AS (SELECT g.image_id, y, x, d > least(80.0::DOUBLE, greatest(28.0::DOUBLE, q * 0.55::DOUBLE)) AS ink FROM {n('fg')} g JOIN (SELECT image_id, quantile_cont(d, 0.75) AS q FROM {n('fg')} GROUP BY image_id) USING (image_id)),
{n('fi')} AS (SELECT a.image_id, a.y, a.x, bool_or(b.ink) AS ink FROM {n('fh')} a JOIN {n('fh')} b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
{n('fj')} AS (SELECT a.image_id, a.y, a.x FROM {n('fi')} a JOIN {n('fi')} b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL HAVING bool_and(b.ink)),
{to} AS (SELECT p.image_id, p.y, p.x, {', '.join(f'CASE WHEN j.x IS NOT NULL THEN e.{c} ELSE p.{c} END AS {c}' for c in 'rgb')} FROM {source} p LEFT JOIN {n('fj')} j ON j.image_id = p.image_id AND j.y = p.y AND j.x = p.x LEFT JOIN {n('fe')} e ON e.image_id = p.image_id)"""


#: Both words painted over, one after the other: from px0 to px.
ERASE = ", " + WORDS + fill_sql(0, "px0", "px1") + fill_sql(1, "px1", "px")


@query(sql(ERASE, "SELECT * FROM px", PIXELS.replace("px AS", "px0 AS")))
def lyr_8_without_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.without_text(images(spark, sf_dir), words(spark, sf_dir), SIDE, SIDE)


@query(sql(LAYERS + ", " + WORDS, """SELECT image_id, layer_id, row_number() OVER (PARTITION BY image_id ORDER BY kind, width * height DESC, y DESC, x DESC, layer_id) AS z FROM (
SELECT image_id, 0 AS kind, layer_id, x, y, width, height FROM la UNION ALL SELECT image_id, 1, 'text_' || printf('%03d', word_no + 1), x, y, width, height FROM wd)"""))
def set_5_layers_and_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = component_layers(spark, sf_dir).select("image_id", F.lit(0).alias("kind"), "layer_id", "x", "y", "width", "height")
    text = words(spark, sf_dir).select("image_id", F.lit(1).alias("kind"), F.format_string("text_%03d", (F.col("word_no") + 1).cast("int")).alias("layer_id"), "x", "y", "width", "height")
    order = Window.partitionBy("image_id").orderBy("kind", F.desc(F.col("width") * F.col("height")), F.desc("y"), F.desc("x"), "layer_id")
    return raster.unionByName(text).select("image_id", "layer_id", F.row_number().over(order).alias("z"))


@query(sql(DIST, """SELECT image_id, y, x, CAST(round_even(bg_r + (r - bg_r) * a / 255.0::DOUBLE, 0) AS BIGINT) AS r, CAST(round_even(bg_g + (g - bg_g) * a / 255.0::DOUBLE, 0) AS BIGINT) AS g, CAST(round_even(bg_b + (b - bg_b) * a / 255.0::DOUBLE, 0) AS BIGINT) AS b
FROM (SELECT *, CAST(floor(least(255.0, greatest(0.0, (sqrt(d2) - 12) / 58 * 255))) AS BIGINT) AS a FROM ds) JOIN bg USING (image_id)"""))
def evl_1_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = images(spark, sf_dir)
    shown = distances(spark, sf_dir).withColumn("alpha", pixels.alpha(F.col("d2"), 12, 70)).withColumn("z", F.lit(1))
    return ly.composite(bg.corner_background(px, SIDE, SIDE), shown)


@query(sql(", " + WORDS, "SELECT image_id, word_no, greatest(0, x - 2) AS x, greatest(0, y - 2) AS y, least(8, x + width + 2) - greatest(0, x - 2) AS width, least(8, y + height + 2) - greatest(0, y - 2) AS height FROM wd"))
def prj_8_padded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = pixels.padded({k: F.col(k) for k in ("x", "y", "width", "height")}, 2, F.lit(SIDE), F.lit(SIDE))
    return words(spark, sf_dir).select("image_id", "word_no", *[v.alias(k) for k, v in box.items()])


@query(f"WITH {CANDIDATES} SELECT image_id, ord, array_to_string(list_filter([CASE WHEN mae IS NOT NULL THEN 'mae' END, CASE WHEN edge_f1 IS NOT NULL THEN 'edge_f1' END, 'raster_layers'], lambda k: k IS NOT NULL), ',') AS keys FROM c")
def prj_17_compact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.sources.derived import candidates

    kept = selection.compact(["mae", "edge_f1", "raster_layers"])
    return candidates(spark, sf_dir).select("image_id", "ord", F.array_join(F.map_keys(kept), ",").alias("keys"))


@query("SELECT p_partkey, CASE WHEN t IN ('none', 'all', 'large') THEN t ELSE 'large' END AS text_mode, CASE WHEN o = 'zip' AND p_size > 1 THEN 'zip' ELSE 'deck' END AS output FROM (SELECT p_partkey, p_size, ['none', 'all', 'large', 'other'][p_partkey % 4 + 1] AS t, ['zip', 'deck', 'odd'][p_partkey % 3 + 1] AS o FROM part)")
def prj_18_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *of: F.array(*map(F.lit, of))[(F.col("p_partkey") % len(of)).cast("int")]
    mode = strings.one_of(pick("none", "all", "large", "other"), ["none", "all", "large"], "large")
    return table(spark, sf_dir, "part").select("p_partkey", mode.alias("text_mode"), strings.output_mode(pick("zip", "deck", "odd"), F.col("p_size")).alias("output"))


@query("""WITH u AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN [] WHEN 1 THEN [url] ELSE [url, 'other.png'] END AS names FROM pages),
s AS (SELECT *, coalesce(nullif(substring(regexp_replace(regexp_replace(regexp_replace(regexp_extract(coalesce(names[1], 'lamina_output'), '([^/]*)/*$', 1), '^(.+)\\.[^.]+$', '\\1'), '\\s', '_', 'g'), '[^\\p{L}\\p{N}_-]', '', 'g'), 1, 80), ''), 'lamina_output') AS stem FROM u)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CASE WHEN len(names) > 1 THEN 'lamina_' || len(names) || '_pptx_layers.zip' ELSE 'lamina_pptx_layers.zip' END WHEN len(names) > 1 THEN 'lamina_' || len(names) || '_slides_layers.pptx' ELSE stem || '_layers.pptx' END AS name FROM s""")
def str_3_download_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, url = F.col("page_id"), F.col("url")
    names = F.when(k % 4 == 0, F.expr("cast(array() as array<string>)")).when(k % 4 == 1, F.array(url)).otherwise(F.array(url, F.lit("other.png")))
    return table(spark, sf_dir, "pages").select("page_id", strings.download_name(names, k % 3 == 0).alias("name"))


@query("SELECT event_id, array_to_string(list_sort(map_keys(m)), ',') AS keys, m['type'] AS kind, m['user'] AS who FROM (SELECT event_id, MAP {'type': CASE WHEN event_id % 2 = 0 THEN 'changed' ELSE event_type END, 'user': CAST(user_id AS VARCHAR)} AS m FROM events)")
def str_14_merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    other = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("type"), F.lit("changed")))
    m = table(spark, sf_dir, "events").select("event_id", strings.merged_maps(own, other).alias("m"))
    return m.select("event_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.col("m")["type"].alias("kind"), F.col("m")["user"].alias("who"))


@query(f"""WITH {CANDIDATES} SELECT image_id, 'Choose the best candidate.' || chr(10) || chr(10) || 'Image: image ' || image_id || chr(10) || 'Candidates: [' || string_agg('{{' || CASE WHEN mae IS NULL THEN '' ELSE '"mae":' || mae::DOUBLE || ',"edge_f1":' || edge_f1::DOUBLE || ',' END || '"raster_layers":' || raster_layers || ',"largest_layer_ratio":' || largest_layer_ratio::DOUBLE || ',"internal_detail_layers":' || internal_detail_layers || ',"index":' || ord || '}}', ', ' ORDER BY ord) || ']' || chr(10) || chr(10) || 'Return exactly this JSON shape:' || chr(10) || '{selection.ANSWER}' AS prompt FROM c GROUP BY image_id""")
def str_15_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.sources.derived import candidates

    return selection.candidate_prompt(candidates(spark, sf_dir).withColumn("name", F.concat(F.lit("image "), F.col("image_id").cast("string"))))


@query(f"""SELECT p_partkey AS image_id, 'Diagnose the layers.' || chr(10) || chr(10) || 'Metadata: {{"background_color":"' || p_brand || '","raster_layers":' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ',"ocr_lines":' || p_partkey % 7 END || '}}' || chr(10) || chr(10) || 'Return exactly this JSON shape: {selection.DIAGNOSIS}' AS prompt FROM part""")
def str_15_metadata_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    facts = table(spark, sf_dir, "part").select(k.alias("image_id"), F.col("p_brand").alias("background_color"), F.col("p_size").alias("raster_layers"), F.when(k % 3 != 0, k % 7).alias("ocr_lines"))
    return selection.metadata_prompt(facts)


@query("WITH t AS (SELECT l_orderkey AS k, l_quantity AS v, min(l_linenumber * 100000000 + l_partkey) AS o FROM lineitem GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, v) AS n FROM t) SELECT k, string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY n) AS found FROM n GROUP BY k")
def set_2_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("long").cast("string").alias("v"), F.col("l_quantity").alias("q"), (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey")).alias("o"))
    first = rows.groupBy("k", "v").agg(F.min("o").alias("o"), F.first("q").alias("q"))
    return first.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "q", "v"))), lambda s: s["v"]), ",").alias("found"))


@query(f"WITH {SCORED} SELECT bl.image_id, ord, name, round(local_score, 6) AS local_score FROM bl JOIN (VALUES (0, 'heavy'), (1, 'heavy_lite'), (2, 'granular'), (3, 'balanced'), (4, 'light')) s(place, name) ON place = ord % 5")
def evl_4_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scored(spark, sf_dir)
    names = F.array(*[F.lit(n) for n, *_ in selection.SPECS])
    best = selection.best_local(c).join(c, ["image_id", "ord"])
    return best.select("image_id", "ord", names[(F.col("ord") % 5).cast("int")].alias("name"), F.round("exact", 6).alias("local_score"))


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE trim(c_name) END, ''), nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, ''), 'default') AS chain FROM customer")
def evl_8_first_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", strings.first_set(F.when(k % 3 == 0, "").otherwise(F.trim("c_name")), F.when(k % 2 == 0, F.col("c_mktsegment")), default="default").alias("chain"))


@query(f"""WITH {CANDIDATES}, {VOTES}, i AS (SELECT DISTINCT image_id FROM c), o AS (SELECT v.* FROM v SEMI JOIN i USING (image_id)), f AS (SELECT image_id, model_ord FROM o WHERE NOT ok ORDER BY image_id, model_ord LIMIT 3)
SELECT (SELECT arg_min(model_ord, struct_pack(a := image_id, b := model_ord)) FROM o WHERE ok) AS model_used, (SELECT count(DISTINCT image_id) FROM o WHERE ok) AS slides_judged, (SELECT count(*) FROM i) - (SELECT count(DISTINCT image_id) FROM o WHERE ok) AS slides_local_fallback,
(SELECT string_agg(image_id || ':' || model_ord, ',' ORDER BY image_id, model_ord) FROM f) AS judge_errors""")
def agg_23_agent_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.sources.derived import candidates, votes

    return selection.agent_state(candidates(spark, sf_dir), votes(spark, sf_dir))
