import re
import sys

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_neardup import classes_by_hand, corpus
from test_private import by_hand

from lamina.llm import private
from lamina.sources.tables import folders


def test_stages(spark, tmp_path):
    near = [(i, t, "xx", "src", 1) for i, t in corpus()]
    words = "the and of with that reading writing over under house"
    clean = [(1000 + i, f"{words} number{i} said plainly while mail{i % 2} waits", "en", "src", 1) for i in range(5)]
    told = [(2000, "please write to some.one@mail.example.com about the matter of the house and the garden", "en", "src", 1)]
    copies = [(3000, words, "en", "src", 1), (3000, words, "en", "src", 1), (None, words, "en", "src", 1), (3001, "12 34", "en", None, None)]
    rows = near + clean + told + copies
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copy long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        found = stage(spark, docs, folder)
        found.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs.collect()
        if name != "pack":
            assert docs.columns == columns
    letters = [r for r in rows if re.search("[a-z]", r[1] or "", re.I)]
    stays = {r["doc_id"] for r in kept["language"]}
    letters = [r for r in letters if r[0] in stays or len(r[1]) > 10]  # a few letters may be like no language
    assert sorted(r["doc_id"] or -1 for r in kept["language"]) == sorted(r[0] or -1 for r in letters)
    by_id = {r[0]: r[1] for r in letters if r[0] is not None}
    classes = classes_by_hand(sorted(by_id.items()))
    assert sorted(r["doc_id"] for r in kept["near_duplicates"] if r["doc_id"] is not None) == sorted({c for c in classes.values()})
    assert all(r["doc_id"] is not None for r in kept["near_duplicates"])  # a copy without an id goes
    texts = {r["doc_id"]: r["text"] for r in kept["sanitise"]}
    assert "@" not in texts[2000] and all(texts[r[0]] == r[1] for r in clean if r[0] in texts)
    assert all(not by_hand(t) for t in texts.values())
    assert {r["doc_id"] for r in kept["pack"]} == set(texts)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "sanitise", "pack"]


def test_columns_of_any_type_are_kept_and_stages_leave_one_copy(spark, tmp_path):
    texts = [f"the house and the garden of the old man number {i} with water and some more words in the morning" for i in range(6)]
    docs = spark.createDataFrame([(i, t, "en", {"a": i}, [(i, {"b": 1.5})]) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, lang string, more map<string, int>, deep array<struct<x: int, y: map<string, double>>>")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "more", "deep"]
        assert all(r["more"]["a"] == r["deep"][0]["x"] == r["doc_id"] for r in docs.collect() if r["doc_id"] < 6)
    before = folders(spark)
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(folders(spark)) - set(before)) == 1 and found.count()


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert private.KINDS and "lamina" in sys.modules


def test_language_stage_takes_decisions(spark):
    rng = np.random.default_rng(4)
    common = "the of and that with from this have not were their which when there would about other people water through between small house learn write".split()
    rows = [(i, " ".join(rng.choice(common, 60)), "en") for i in range(40)]
    short = [(100 + i, t, None) for i, t in enumerate(["a", "zq", "OK", "x 1 y", "жук"])]
    sets = ["abcdefghijklmnopqrstuvwxyz    ", "0123456789abcdef", "".join(map(chr, range(0x430, 0x450))) + "     ", "".join(map(chr, range(0x4E00, 0x5200)))]
    strange = [(200 + 10 * k + i, "".join(rng.choice(list(letters), 400)), None) for k, letters in enumerate(sets) for i in range(5)]
    docs = spark.createDataFrame([*rows, *short, *strange, (300, "12 34", None)], "doc_id long, text string, lang string")
    kept = lambda d: {r["doc_id"] for r in corpus_pipeline.keep_known_languages(spark, d, "").collect()}
    assert kept(docs) == {r[0] for r in rows + short}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert kept(unlabelled) == {r[0] for r in rows + short + strange}


def test_rows_with_shared_ids_and_clashing_columns(spark):
    """No unique text is lost to an id that stands on others, and no column is overwritten."""
    own = ["the house and the garden of the old man with water and wood in the morning", "people would write about their small house when there is light on the water", "which of them were not there when the learning began with reading and other things"]
    names = ["copy", "nth", "score", "lang_pred", "row_id", "row_digest", "likely", "node", "digest", "label", "n", "key"]
    texts = [(1, own[0]), (5, own[0]), (5, own[1]), (7, own[1] + "!"), (None, own[2]), (None, own[2].upper()), (7, own[0]), (5, own[1])]
    rows = [(i, t, "en", *[f"{c}{k}" for c in names]) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in names))
    known = corpus_pipeline.keep_known_languages(spark, docs, "")
    assert sorted(map(str, known.collect())) == sorted(map(str, docs.collect()))
    kept = corpus_pipeline.keep_one_of_each_class(spark, docs, "")
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((r["doc_id"] or 0, r["text"].lower()) for r in got) == sorted([(1, own[0]), (5, own[1]), (0, own[2])])
    assert all(tuple(r) in rows for r in got)
    clean = corpus_pipeline.sanitise_texts(spark, docs, "").collect()
    assert sorted(str(r[3:]) for r in clean) == sorted(str(tuple(r[3:])) for r in rows)
    assert corpus_pipeline.pack_sequences(spark, docs, "").select("doc_id").distinct().count() == 4
