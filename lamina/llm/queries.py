"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import conversations, kneser_ney, language, licences, media, neardup, negatives, neighbours, packing, pieces, private, sql, tokenfiles, tokens
from lamina.llm.common import crc_fold, table, written


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.find_private(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_fold(F.col("doc_id")) == 0
    profiles = language.Profiles.fit(docs.where(~held_out))
    return profiles.predict(docs).select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op4_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op6_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.fit(docs.where(crc_fold(F.col("doc_id")) != 1), order=kneser_ney.ORDER)
    scored = kneser_ney.score(docs, model)
    return scored.select("doc_id", (crc_fold(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a page: its first line, a figure that refers to its payload, and the rest. Its one media part is resolved against the stored payloads."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = media.read_media(written(media.media_table(docs, "doc_id", "text").select("media")))
    said = F.coalesce("text", F.lit(""))
    escaped = F.replace(F.replace(said, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    line = F.coalesce(F.nullif(F.instr(escaped, F.lit("\n")), F.lit(0)), F.length(escaped) + 1)
    figure = F.concat(F.lit('<figure><img src="sha256:'), media.payload_digest("text"), F.lit('"><figcaption>document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure>"))
    html = F.concat(F.lit("<article><p>"), F.substring(escaped, F.lit(1), line - 1), F.lit("</p>"), figure, F.lit("<p>"), F.substring(escaped, line + 1, F.length(escaped)), F.lit("</p></article>"))
    pages = docs.select("doc_id", F.octet_length(said).cast("long").alias("n_bytes"), html.alias("html"))
    parts = media.parse_pages(pages, "html", "doc_id", "n_bytes").select("doc_id", "n_bytes", F.size("parts").alias("n_parts"), F.filter("parts", lambda p: p["kind"] == "media")[0].alias("part"))
    references = written(parts.select("doc_id", "n_bytes", "n_parts", "part.position", "part.caption", "part.digest"))
    return media.resolve(references, stored).select("doc_id", "n_bytes", "media.*", "position", "caption", "n_parts")


def op11_orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.digests(tokenfiles.written_ids(table(spark, sf_dir, "documents")).rows())


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.expr("try_add(cast(label as bigint), 1L)") % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired_conversations(conversations.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op12_hard_negatives": sql.HARD_NEGATIVES, "op13_conversation_repair": sql.CONVERSATION_REPAIR}
