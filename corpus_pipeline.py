"""Corpus pipeline: language identification, near-duplicate removal, sanitisation, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.
Nulls: a null text has no language and goes in the first stage. Rows are told apart by id and text: an id that stands
on several texts, or none, decides for no other text. Repeated rows (same id and text) are copies, of which one stays.
Extra columns, whatever their names, are kept as they are until texts become sequences; an empty table gives empty
stages. Stages lower the session's rows of an Arrow batch to 1,000, since they return before Spark reads that setting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import language, neardup, packing, private
from lamina.llm.common import bound_batches, shared_dir, written
from lamina.sources.tables import discard, folders


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those that are too unlike the language they are most like, go. All labelled rows are learnt; without any, all documents with letters stay."""
    bound_batches(spark)
    return language.Profiles.fit(docs).likely_rows(docs)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class stays; one without an id only where all are."""
    bound_batches(spark)
    return neardup.one_of_each_class(docs)


def sanitise_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced; every document stays."""
    bound_batches(spark)
    return private.sanitise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_class),
    ("sanitise", sanitise_texts),
    ("pack", pack_sequences),
]

#: Hash vectors, registers and tokenizers aren't SQL; tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. What a stage has read and made goes when its result is written, so that one copy of the documents stays, which the result is read from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = set(folders(spark))
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            place = shared_dir(spark)
            docs = written(docs, place)
            discard(spark, [f for f in folders(spark) if f not in others and f != place])
    return docs
