"""Candidate races: scores, votes of judges, and the choice. Candidates: image_id, ord and metrics, null if missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The candidates of a race (name, preset, compact), in order.
SPECS = [("heavy", "heavy", False), ("heavy_lite", "heavy", True), ("granular", "granular", False), ("balanced", "auto", False), ("light", "grouped", False)]


def local_score(mae: Column, f1: Column, layers: Column, largest: Column, details: Column) -> Column:
    """Fidelity, editability, detail and grouping in one number; missing metrics count as the worst."""
    mae, f1, layers, largest, details = F.coalesce(mae, F.lit(999.0)), F.coalesce(f1, F.lit(0.0)), F.coalesce(layers, F.lit(1)), F.coalesce(largest, F.lit(1.0)), F.coalesce(details, F.lit(0))
    editable = F.least(F.lit(2.6), F.log1p(layers) / F.log1p(F.lit(1200.0)) * 2.6)
    return mae * -0.35 + f1 * 4 + editable + F.least(F.lit(0.8), details / 250.0) - F.greatest(F.lit(0.0), largest - 0.22) * 3


def race(images: DataFrame, spark: SparkSession) -> DataFrame:
    """Every image with each of the five candidates: ord, name, mode, compact. The specs are part of the plan, not a table."""
    specs = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(m).alias("mode"), F.lit(c).alias("compact")) for i, (n, m, c) in enumerate(SPECS)])
    return images.select("*", F.explode(specs).alias("s")).select(*images.columns, "s.*")


def grid(images: DataFrame, modes: list[str], thresholds: list[float]) -> DataFrame:
    """Every image with each mode and threshold, in that order."""
    cells = [F.struct(F.lit(i * len(thresholds) + k).alias("ord"), F.lit(m).alias("mode"), F.lit(float(t)).alias("threshold")) for i, m in enumerate(modes) for k, t in enumerate(thresholds)]
    return images.select("*", F.explode(F.array(*cells)).alias("s")).select(*images.columns, "s.*")


def least_error(candidates: DataFrame) -> DataFrame:
    """image_id, ord: the smallest mae, then the largest edge_f1, then the first; without metrics the first candidate."""
    known = F.col("mae").isNotNull()
    return candidates.groupBy("image_id").agg(F.coalesce(F.min_by(F.when(known, F.col("ord")), F.when(known, F.struct("mae", -F.col("edge_f1"), "ord"))), F.min("ord")).alias("ord"))


def best_local(scored: DataFrame) -> DataFrame:
    """image_id, ord: the largest local_score (missing: -9999), ties to the first."""
    return scored.groupBy("image_id").agg(F.max_by("ord", F.struct(F.coalesce("local_score", F.lit(-9999.0)), -F.col("ord"))).alias("ord"))


def tallies(votes: DataFrame, candidates: DataFrame) -> DataFrame:
    """image_id, ord, votes, first_vote: valid votes for each candidate."""
    valid = votes.where("ok").groupBy("image_id", F.col("winner_index").alias("ord")).agg(F.count("*").alias("votes"), F.min("model_ord").alias("first_vote"))
    return valid.join(candidates.select("image_id", "ord"), ["image_id", "ord"], "left_semi")


def winners(tally: DataFrame, fallback: DataFrame) -> DataFrame:
    """image_id, ord, votes: most votes, then the fallback's choice, then the candidate voted for first; the fallback's where there are no votes."""
    f = fallback.select("image_id", F.col("ord").alias("own"))
    key = F.struct("votes", (F.col("ord") == F.col("own")).cast("int"), -F.col("first_vote"))
    voted = tally.join(f, "image_id").groupBy("image_id").agg(F.max_by(F.struct("ord", "votes"), key).alias("w"))
    return f.join(voted, "image_id", "left").select("image_id", F.coalesce("w.ord", "own").alias("ord"), F.coalesce("w.votes", F.lit(0)).alias("votes"))


#: So many failure modes and changes of an ensemble are kept.
FAILURES, CHANGES = 8, 4


def ensemble(votes: DataFrame, candidates: DataFrame, local: DataFrame) -> DataFrame:
    """image_id, ord, votes, quality, judges, model_used, failure_modes and next_change (null without any): what the judges that answered say together.

    votes: image_id, model_ord, winner_index, quality_score, failure_mode, next_change, ok. Most votes win, ties go to the
    local choice (image_id, ord), then to the candidate voted for first; without a vote for a candidate the local choice
    stands. Qualities that are missing don't count. Images that no judge has answered for have no row.
    """
    heard = votes.where("ok").join(local.select("image_id"), "image_id", "left_semi")
    models = F.concat(F.lit("ensemble:"), F.array_join(F.sort_array(F.collect_list("model_ord")).cast("array<string>"), ","))
    said = heard.groupBy("image_id").agg(F.coalesce(F.avg(rescaled(F.col("quality_score"))), F.lit(0.0)).alias("quality"), F.count("*").alias("judges"), models.alias("model_used"))
    failures = ordered_distinct(heard, "image_id", "failure_mode", "model_ord", FAILURES).select("image_id", F.col("values").alias("failure_modes"))
    changes = ordered_distinct(heard.withColumn("next_change", F.trim("next_change")), "image_id", "next_change", "model_ord", CHANGES).select("image_id", F.array_join("values", " | ").alias("next_change"))
    won = winners(tallies(votes, candidates), local)
    return said.join(won, "image_id").join(failures, "image_id", "left").join(changes, "image_id", "left").select("image_id", "ord", "votes", "quality", "judges", "model_used", "failure_modes", "next_change")


def rescaled(quality: Column) -> Column:
    """A judge's quality: percentages become fractions, then all are cut to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(quality > 1, quality / 100).otherwise(quality)))


def ordered_distinct(rows: DataFrame, key: str, value: str, order: str, limit: int) -> DataFrame:
    """key, values: distinct values in order of their first occurrence, so many at most."""
    first = rows.where(F.col(value).isNotNull() & (F.trim(value) != "")).groupBy(key, value).agg(F.min(order).alias("o"))
    kept = first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("o", value))).where(F.col("n") <= limit)
    return kept.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", value))), lambda s: s[value]).alias("values"))


def biased_means(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Means that count a missing metric as 0."""
    return rows.agg(*[(F.sum(F.coalesce(m, F.lit(0.0))) / F.greatest(F.lit(1), F.count("*"))).alias(m) for m in metrics])


def pivoted(candidates: DataFrame, key: Column, keys: list[str], metrics: list[str]) -> DataFrame:
    """image_id and a column for each metric and key."""
    c = candidates.withColumn("key", key)
    return c.groupBy("image_id").agg(*[F.first(F.when(F.col("key") == k, F.col(m)), True).alias(f"{m}_{k}") for k in keys for m in metrics])


def report(candidates: DataFrame, votes: DataFrame, key: Column, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row for each image: the chosen candidate's columns, selected_mode, selected_threshold, judge_model, judge_error, and a column for each metric and key of all candidates.

    The judge that answers first chooses, if it names a candidate, or else the least error does. judge_error: the first
    judge that failed, where none answered. key: of a candidate, one of keys.
    """
    heard = votes.groupBy("image_id").agg(F.min_by(F.when(F.col("ok"), F.col("winner_index")), F.when(F.col("ok"), F.col("model_ord"))).alias("winner"), F.min(F.when(F.col("ok"), F.col("model_ord"))).alias("judge_model"), F.min(F.when(~F.col("ok"), F.col("model_ord"))).alias("failed"))
    named = candidates.select("image_id", F.col("ord").alias("winner"), F.lit(True).alias("named"))
    chosen = least_error(candidates).join(heard, "image_id", "left").join(named, ["image_id", "winner"], "left")
    chosen = chosen.select("image_id", F.when(F.col("named"), F.col("winner")).otherwise(F.col("ord")).alias("ord"), "judge_model", F.when(F.col("judge_model").isNull(), F.col("failed")).alias("judge_error"))
    rows = candidates.join(chosen, ["image_id", "ord"]).withColumns({"selected_mode": F.col("candidate_mode"), "selected_threshold": F.col("candidate_threshold")})
    return rows.join(pivoted(candidates, key, keys, metrics), "image_id")


def zipped(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both sides with the same place within the key; the longer side is cut."""
    numbered = lambda t: t.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    r = numbered(right)
    return numbered(left).join(r.select(key, "place", *[F.col(c).alias(f"{c}_right") for c in right.columns if c != key]), [key, "place"])


def union_of_keys(*tables: DataFrame) -> DataFrame:
    """All rows, with every column that any table has."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def compact(names: list[str]) -> Column:
    """The named columns that have a value, as a map of texts."""
    every = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])
    return F.map_filter(every, lambda k, v: v.isNotNull())


def stretch(rows: DataFrame, key: str, order: list[str], start: int = 1, limit: int | None = None) -> DataFrame:
    """The rows of each key from the start-th on (counted from 1), so many at most, with their place."""
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return placed.where((F.col("place") >= start) & (F.lit(True) if limit is None else F.col("place") < start + limit))


def agent_state(candidates: DataFrame, votes: DataFrame) -> DataFrame:
    """One row: the model that answered first, images judged, images left to the local score, and the first three errors (as texts, by image). votes: of the judges, with ok."""
    images = candidates.select("image_id").distinct()
    own = votes.join(images, "image_id", "left_semi")
    judged = own.where("ok").agg(F.count_distinct("image_id").alias("slides_judged"), F.min_by("model_ord", F.struct("image_id", "model_ord")).alias("model_used"))
    failed = own.where("not ok").select("image_id", "model_ord").orderBy("image_id", "model_ord").limit(3)
    said = F.transform(F.sort_array(F.collect_list(F.struct("image_id", "model_ord"))), lambda s: F.concat_ws(":", s["image_id"], s["model_ord"]))
    errors = failed.agg(F.array_join(said, ",").alias("judge_errors"))
    total = images.agg(F.count("*").alias("images"))
    parts = total.unionByName(judged, allowMissingColumns=True).unionByName(errors, allowMissingColumns=True)  # one row each
    one = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    return one.select("model_used", "slides_judged", (F.col("images") - F.col("slides_judged")).alias("slides_local_fallback"), "judge_errors")


def layer_features(layers: DataFrame, images: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, largest_layer_ratio (box over slide), internal_detail_layers, internal_detail_base_layers; 1, 0 and 0 without layers."""
    detail, base = F.col("layer_id").contains("_detail_"), F.col("layer_id").endswith("_base")
    found = layers.groupBy("image_id").agg((F.max(F.col("width") * F.col("height")) / max(1, width * height)).alias("largest_layer_ratio"), F.count_if(detail).alias("internal_detail_layers"), F.count_if(base).alias("internal_detail_base_layers"))
    return images.join(found, "image_id", "left").select("image_id", F.coalesce("largest_layer_ratio", F.lit(1.0)).alias("largest_layer_ratio"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("internal_detail_layers", "internal_detail_base_layers")])


#: What a judge is told of a candidate, and the shape of its answer.
TOLD = ["candidate_mode", "candidate_threshold", "mae", "rmse", "psnr", "edge_f1", "raster_layers", "shapes", "text_shapes", "raw_components", "foreground_pixels", "largest_layer_ratio", "internal_detail_layers", "internal_detail_base_layers", "local_score", "render_error"]
ANSWER = '{"winner_index": number, "winner_reason": string, "quality_score": number, "failure_modes": [string], "next_pipeline_change": string}'


def candidate_prompt(candidates: DataFrame, task: str = "Choose the best candidate.") -> DataFrame:
    """image_id, prompt: what a judge is asked: the task, the image's name, its candidates in order as JSON (what is known of TOLD, and their index), and the shape of the answer. candidates: image_id, ord, name (of the image) and some of TOLD."""
    known = F.to_json(F.struct(*[c for c in TOLD if c in candidates.columns], F.col("ord").alias("index")))
    each = F.transform(F.sort_array(F.collect_list(F.struct("ord", known.alias("json")))), lambda s: s["json"])
    text = F.concat(F.lit(f"{task}\n\nImage: "), F.coalesce(F.first("name", True), F.lit("")), F.lit("\nCandidates: ["), F.array_join(each, ", "), F.lit(f"]\n\nReturn exactly this JSON shape:\n{ANSWER}"))
    return candidates.groupBy("image_id").agg(text.alias("prompt"))


#: Fixed value: the shape of the answer on one image's metadata.
DIAGNOSIS = '{"quality_risk": string, "recommended_preset": string, "next_pipeline_change": string, "confidence": number}'


def metadata_prompt(metadata: DataFrame, task: str = "Diagnose the layers.") -> DataFrame:
    """image_id, prompt: what is asked about an image's metadata (all other columns, as JSON)."""
    known = F.to_json(F.struct(*[c for c in metadata.columns if c != "image_id"]))
    return metadata.select("image_id", F.concat(F.lit(f"{task}\n\nMetadata: "), known, F.lit(f"\n\nReturn exactly this JSON shape: {DIAGNOSIS}")).alias("prompt"))
