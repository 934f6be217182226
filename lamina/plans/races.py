"""Queries on candidates, votes and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.model import PRESETS, presets
from lamina.operators import metrics, selection
from lamina.plans.registry import query
from lamina.sources.derived import CANDIDATES, JOBS, VOTES, candidates, job_events, table, votes
from lamina.streaming import jobs

SCORED = CANDIDATES + """, sc AS (SELECT *, -0.35::DOUBLE * coalesce(mae, 999) + 4 * coalesce(edge_f1, 0) + least(2.6::DOUBLE, ln(1 + coalesce(raster_layers, 1)) / ln(1201) * 2.6::DOUBLE) + least(0.8::DOUBLE, internal_detail_layers / 250.0::DOUBLE) - 3 * greatest(0.0::DOUBLE, largest_layer_ratio - 0.22::DOUBLE) AS local_score FROM c),
bl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(local_score, 9) DESC, ord) AS k FROM sc) WHERE k = 1)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    score = selection.local_score(*map(F.col, ("mae", "edge_f1", "raster_layers", "largest_layer_ratio", "internal_detail_layers")))
    return c.withColumn("exact", score).withColumn("local_score", F.round("exact", 9))  # rounded, so that both engines see the same ties


@query(f"WITH {SCORED} SELECT image_id, ord, round(local_score, 6) AS local_score FROM sc")
def prj_16_local_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("image_id", "ord", F.round("exact", 6).alias("local_score"))


@query(f"WITH {CANDIDATES}, s0 AS (SELECT image_id, ord, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 - 1.8::DOUBLE * coalesce(mae, 999) + 25 * (coalesce(edge_f1, 0) - 0.8::DOUBLE))) AS s FROM c) SELECT image_id, ord, round(s, 6) AS score, CASE WHEN round(s, 9) >= 92 THEN 'A' WHEN round(s, 9) >= 86 THEN 'B+' WHEN round(s, 9) >= 78 THEN 'B' WHEN round(s, 9) >= 68 THEN 'C' ELSE 'D' END AS grade FROM s0")
def prj_15_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("s", F.round(metrics.quality_score(F.col("mae"), F.col("edge_f1")), 9))
    return c.select("image_id", "ord", F.round("s", 6).alias("score"), metrics.grade(F.col("s")).alias("grade"))


VALUES = ", ".join(f"('{m}', {str(c).lower()}, {o.bg_threshold}, {o.min_area_px}, {o.max_layers}, {o.alpha_low}, {o.alpha_high})" for (m, c), o in PRESETS.items())


@query(f"WITH ps(mode, compact, bg_threshold, min_area_px, max_layers, alpha_low, alpha_high) AS (VALUES {VALUES}), w AS (SELECT vec_id AS image_id, ['heavy', 'granular', 'grouped', 'auto'][vec_id % 4 + 1] AS asked, vec_id % 3 = 0 AS compact FROM embeddings) SELECT image_id, asked, compact, bg_threshold, min_area_px, max_layers, alpha_low, alpha_high FROM w JOIN ps USING (compact) WHERE ps.mode = CASE WHEN asked IN ('heavy', 'granular', 'grouped') THEN asked ELSE 'balanced' END")
def prj_11_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    asked = F.array(*map(F.lit, ("heavy", "granular", "grouped", "auto")))[(i % 4).cast("int")]
    w = table(spark, sf_dir, "embeddings").select(i.alias("image_id"), asked.alias("asked"), (i % 3 == 0).alias("compact"))
    mode = F.when(F.col("asked").isin("heavy", "granular", "grouped"), F.col("asked")).otherwise("balanced")
    return w.withColumn("mode", mode).join(F.broadcast(presets(spark)), ["mode", "compact"]).select("image_id", "asked", "compact", "bg_threshold", "min_area_px", "max_layers", "alpha_low", "alpha_high")


@query("SELECT vec_id AS image_id, m * 2 + t AS ord, ['balanced', 'heavy'][m + 1] AS mode, [18.0::DOUBLE, 35.0::DOUBLE][t + 1] AS threshold FROM embeddings, range(2) a(m), range(2) b(t)")
def jon_4_candidate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.grid(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id")), ["balanced", "heavy"], [18.0, 35.0])


@query("SELECT vec_id AS image_id, ord, name, mode, compact FROM embeddings, (VALUES (0, 'heavy', 'heavy', false), (1, 'heavy_lite', 'heavy', true), (2, 'granular', 'granular', false), (3, 'balanced', 'auto', false), (4, 'light', 'grouped', false)) s(ord, name, mode, compact)")
def jon_5_candidate_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.race(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id")), spark)


@query(f"WITH {CANDIDATES} SELECT image_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY mae IS NULL, mae, edge_f1 DESC, ord) AS k FROM c) WHERE k = 1")
def srt_3_least_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.least_error(candidates(spark, sf_dir))


@query(f"WITH {SCORED} SELECT image_id, ord FROM bl")
def srt_4_best_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best_local(scored(spark, sf_dir))


TALLY = SCORED + f""", {VOTES}, ta AS (SELECT image_id, winner_index AS ord, count(*) AS votes, min(model_ord) AS first_vote FROM v WHERE ok GROUP BY ALL),
tv AS (SELECT ta.* FROM ta SEMI JOIN c USING (image_id, ord))"""


@query(f"WITH {TALLY} SELECT * FROM tv")
def agg_16_vote_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.tallies(votes(spark, sf_dir), candidates(spark, sf_dir))


@query(f"WITH {TALLY}, w AS (SELECT tv.image_id, tv.ord, votes, row_number() OVER (PARTITION BY tv.image_id ORDER BY votes DESC, tv.ord = bl.ord DESC, first_vote) AS n FROM tv JOIN bl ON bl.image_id = tv.image_id) SELECT bl.image_id, coalesce(w.ord, bl.ord) AS ord, coalesce(votes, 0) AS votes FROM bl LEFT JOIN w ON w.image_id = bl.image_id AND n = 1")
def srt_5_vote_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.winners(selection.tallies(votes(spark, sf_dir), candidates(spark, sf_dir)), selection.best_local(scored(spark, sf_dir)))


@query(f"WITH {TALLY}, j AS (SELECT image_id, winner_index FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY model_ord) AS n FROM v WHERE ok) WHERE n = 1) SELECT bl.image_id, coalesce(c.ord, bl.ord) AS ord, c.ord IS NOT NULL AS judged FROM bl LEFT JOIN j ON j.image_id = bl.image_id LEFT JOIN c ON c.image_id = bl.image_id AND c.ord = j.winner_index")
def jon_6_judge_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = votes(spark, sf_dir).where("ok").groupBy("image_id").agg(F.min_by("winner_index", "model_ord").alias("ord"))
    judged = first.join(candidates(spark, sf_dir).select("image_id", "ord"), ["image_id", "ord"], "left_semi").withColumnRenamed("ord", "judge")
    return selection.best_local(scored(spark, sf_dir)).join(judged, "image_id", "left").select("image_id", F.coalesce("judge", "ord").alias("ord"), F.col("judge").isNotNull().alias("judged"))


@query(f"WITH {VOTES} SELECT image_id, round(coalesce(avg(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN quality_score > 1 THEN quality_score / 100 ELSE quality_score END))), 0), 6) AS quality FROM v WHERE ok GROUP BY image_id")
def agg_17_mean_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes(spark, sf_dir).where("ok").groupBy("image_id").agg(F.round(F.coalesce(F.avg(selection.rescaled(F.col("quality_score"))), F.lit(0.0)), 6).alias("quality"))


def distinct_sql(column: str, limit: int, separator: str) -> str:
    return f"WITH {VOTES}, f AS (SELECT image_id, {column} AS x, min(model_ord) AS o FROM v GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY o, x) AS n FROM f) SELECT image_id, string_agg(x, '{separator}' ORDER BY n) AS found FROM k WHERE n <= {limit} GROUP BY image_id"


@query(distinct_sql("failure_mode", 8, ";"))
def agg_18_failure_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.ordered_distinct(votes(spark, sf_dir), "image_id", "failure_mode", "model_ord", 8).select("image_id", F.array_join("values", ";").alias("found"))


@query(distinct_sql("next_change", 4, " | "))
def agg_19_next_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.ordered_distinct(votes(spark, sf_dir), "image_id", "next_change", "model_ord", 4).select("image_id", F.array_join("values", " | ").alias("found"))


@query(f"WITH {CANDIDATES} SELECT round(sum(coalesce(mae, 0)) / count(*), 6) AS mae, round(sum(coalesce(edge_f1, 0)) / count(*), 6) AS edge_f1 FROM c")
def agg_13_biased_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.biased_means(candidates(spark, sf_dir), ["mae", "edge_f1"]).select(*[F.round(c, 6).alias(c) for c in ("mae", "edge_f1")])


@query(f"WITH {CANDIDATES} SELECT image_id, " + ", ".join(f"max({m}) FILTER (ord = {k}) AS {m}_{k}" for k in (1, 2, 3) for m in ("mae", "edge_f1")) + " FROM c GROUP BY image_id")
def evl_9_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.pivoted(candidates(spark, sf_dir), F.col("ord").cast("string"), ["1", "2", "3"], ["mae", "edge_f1"])


PLACES = [(k, f"heavy_t{k}") for k in range(1, 8)]


@query(f"""WITH {TALLY}, j AS (SELECT image_id, arg_min(winner_index, model_ord) AS winner, min(model_ord) AS model FROM v WHERE ok GROUP BY image_id), e AS (SELECT image_id, min(model_ord) AS failed FROM v WHERE NOT ok GROUP BY image_id),
b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY mae IS NULL, mae, edge_f1 DESC, ord) AS k FROM c),
s AS (SELECT b.image_id, coalesce(c.ord, b.ord) AS ord, j.model AS judge_model, CASE WHEN j.model IS NULL THEN e.failed END AS judge_error FROM b LEFT JOIN j USING (image_id) LEFT JOIN e USING (image_id) LEFT JOIN c ON c.image_id = b.image_id AND c.ord = j.winner WHERE k = 1)
SELECT s.image_id, s.ord, 'heavy' AS selected_mode, s.ord AS selected_threshold, 'judge ' || judge_model AS judge_model, 'judge ' || judge_error AS judge_error, any_value(c.raster_layers) FILTER (c.ord = s.ord) AS raster_layers, """ + ", ".join(f"max(c.{m}) FILTER (c.ord = {k}) AS {m}_{key}" for k, key in PLACES for m in ("mae", "edge_f1")) + " FROM s JOIN c ON c.image_id = s.image_id GROUP BY ALL")
def evl_10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each image: the candidate that its judge chose, or else the one of least error, and the metrics of all by mode and threshold."""
    c = candidates(spark, sf_dir).withColumns({"candidate_mode": F.lit("heavy"), "candidate_threshold": F.col("ord")})
    kept = selection.report(c, votes(spark, sf_dir), F.concat_ws("_t", "candidate_mode", "candidate_threshold"), [key for _, key in PLACES], ["mae", "edge_f1"])
    judge = lambda c: F.concat(F.lit("judge "), F.col(c).cast("string")).alias(c)
    return kept.select("image_id", "ord", "selected_mode", "selected_threshold", judge("judge_model"), judge("judge_error"), "raster_layers", *[f"{m}_{key}" for _, key in PLACES for m in ("mae", "edge_f1")])


@query("WITH a AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders WHERE o_orderkey % 2 = 1) SELECT k, place, a.o_orderkey, b.o_orderkey AS o_orderkey_right FROM a JOIN b USING (k, place)")
def jon_3_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return selection.zipped(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "k", "o_orderkey")


@query("SELECT p_partkey AS key, p_name AS name, NULL::DOUBLE AS acctbal FROM part UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def snk_7_union_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.union_of_keys(table(spark, sf_dir, "part").selectExpr("p_partkey as key", "p_name as name"), table(spark, sf_dir, "supplier").selectExpr("s_suppkey as key", "s_name as name", "s_acctbal as acctbal"))


@query(f"WITH {JOBS} SELECT job_id, arg_max(status, seq) AS status, arg_max(progress, seq) AS progress, arg_max(phase, seq) AS phase, arg_max(message, seq) AS message, max(ts) AS updated_at, count(*) AS events FROM j GROUP BY job_id")
def job_1_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.current(job_events(spark, sf_dir))


@query(f"WITH {JOBS}, s AS (SELECT job_id, arg_max(status, seq) AS status FROM j GROUP BY job_id) SELECT c_custkey AS job_id, CASE WHEN s.job_id IS NULL OR status IS NULL THEN 404 WHEN status = 'done' THEN 200 ELSE 409 END AS code FROM customer LEFT JOIN s ON s.job_id = c_custkey")
def job_4_download_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = jobs.current(job_events(spark, sf_dir)).select("job_id", "status")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id")).join(state, "job_id", "left").select("job_id", jobs.download_status(F.col("status")).alias("code"))


@query(f"WITH {JOBS}, k AS (SELECT job_id, seq, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS k, count(*) OVER (PARTITION BY job_id) AS n FROM j) SELECT job_id, seq, 20 + CAST(round_even((k - 1)::DOUBLE / n * 42, 0) AS BIGINT) AS start_progress, 20 + CAST(round_even(k::DOUBLE / n * 42, 0) AS BIGINT) AS end_progress FROM k")
def win_11_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.progress(job_events(spark, sf_dir), "job_id", "seq").select("job_id", "seq", "start_progress", "end_progress")
