import glob
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import tokenfiles as T
from lamina.llm.common import tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_ids_equal_the_library(library, texts):
    own = T.byte_ids(tokenizer_path("byte_bpe_50k.json"))
    for t in [*texts, "Жук и жаба. 12½ ²x ª×÷ ſ ", "x\x1c y\x1f z w  　v\n  u", "don't DON'T 'tis we'll'", "a  b   c\n\n d\t\te ", " lead", "trail "]:
        assert own.ids(t or "").tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def by_hand(library, rows):
    at, out = 0, []
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("part_bytes", [1 << 20, 200])
def test_files_hold_all_ids_in_order(spark, library, docs, part_bytes):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    files = T.written_ids(docs, part_bytes=part_bytes)
    assert sorted(map(tuple, T.digests(files.rows()).collect()), key=lambda r: r[1]) == by_hand(library, rows)
    assert files.parts().agg(F.sum("n_docs")).first()[0] == len(rows)
    whole = np.concatenate([r["ids"] for r in files.rows().orderBy("start").collect()])
    for start, end in ((0, 7), (5, 400), (len(whole) - 3, len(whole) + 9), (len(whole) + 1, len(whole) + 2)):
        pieces = files.between(start, end).orderBy("start").collect()
        assert [x for p in pieces for x in p["ids"]] == whole[start:end].tolist()


def test_repeated_ids_and_rows_are_separate_and_dealt_to_several_parts(spark):
    docs = spark.createDataFrame([(5, "same words here " * 20)] * 200 + [(None, "x")] * 3 + [(6, None)], "doc_id long, text string")
    files = T.written_ids(docs.selectExpr("*", "1 as part", "'a' as hash", "map('k', 1) as row"), part_bytes=4000)
    found = T.digests(files.rows()).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None] * 3 + [5] * 200 + [6]
    ends = np.cumsum([r["n_tokens"] for r in found])
    assert [r["start"] for r in found] == [0, *ends[:-1]]
    assert files.parts().agg(F.max("n_docs")).first()[0] < 100


def test_no_rows(spark, docs):
    files = T.written_ids(docs.where("false"))
    assert files.rows().count() == 0 and T.digests(files.rows()).count() == 0 and files.between(0, 9).count() == 0


def test_stripes_indexes_and_bloom_filters_prune(spark):
    docs = spark.range(0, 60_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("words "), F.col("id").cast("string")).alias("text"))
    files = T.written_ids(docs, part_bytes=1 << 30, stripe_bytes=100_000)
    (path,) = glob.glob(f"{files.folder}/ids/*.orc")
    jvm = spark._jvm
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    assert reader.getStripes().size() > 1 and reader.getRowIndexStride() == T.GROUP_ROWS
    stripe = reader.getStripes().get(0)
    footer = reader.rows().readStripeFooter(stripe)
    kinds = {(s.getKind().toString(), s.getColumn()) for s in (footer.getStreams(i) for i in range(footer.getStreamsCount()))}
    assert ("BLOOM_FILTER_UTF8", 1) in kinds and ("ROW_INDEX", 1) in kinds
    assert "DIRECT_V2" in footer.getColumns(6).getKind().toString()  # run-length encoded, second version

    def scanned(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [In(doc_id" in plan or "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id" in plan
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        found = [x for x in (leaves.apply(i) for i in range(leaves.size())) if x.nodeName().startswith("Scan orc")]
        return sum(x.metrics().apply("numOutputRows").value() for x in found)

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert [r["ids"][-1] for r in files.lookup([30_000]).collect()] == [2]
        assert 1 <= scanned(files.stored().where("doc_id = 30000")) <= 2 * T.GROUP_ROWS
        assert scanned(files.stored().where("doc_id = 30001")) <= T.GROUP_ROWS  # within the range of a group, but in no Bloom filter (but for a false one)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
