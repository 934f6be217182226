import os
import subprocess
import sys
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import queries
from lamina.llm.common import KeySet, Recent, crc_fold, local_path, looked_up, mapped, shared_dir, slices, store_arrays
from lamina.llm.neardup import mixed


def test_key_sets_hold_their_keys_and_no_others(spark):
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(-(2**63), 2**63, 5000))
    held = KeySet.store(spark.createDataFrame([(int(k),) for k in keys], "k long"), len(keys), part=100)
    other = np.setdiff1d(rng.integers(-(2**63), 2**63, 1000), keys)
    assert held.contains(keys.view(np.uint64)).all() and not held.contains(other.view(np.uint64)).any()
    assert held.bits == 6 and len(held.contains(np.empty(0, np.uint64))) == 0
    empty = KeySet.store(spark.createDataFrame([], "k long"), 0)
    assert not empty.contains(keys.view(np.uint64)).any()


def test_files_are_written_whole_and_mapped(spark):
    name = f"{shared_dir(spark)}/x"
    store_arrays(name, [np.array([7, 8, 9], "u1"), np.arange(2, dtype="<u8"), np.ones((4, 2), "<f4"), np.empty(0)])
    a, b, c, d = mapped(name, ("u1", "<u8", "(2,)<f4", "<f8"))
    assert a.tolist() == [7, 8, 9] and b.tolist() == [0, 1] and c.tolist() == [[1, 1]] * 4 and len(d) == 0
    with pytest.raises(FileNotFoundError):
        mapped(name + "-missing", ("<u8", "u1"))


def test_a_lost_part_is_an_error(spark):
    held = KeySet.store(spark.range(1000).select((F.xxhash64("id")).alias("k")), 1000)
    path = local_path(held.folder)
    for name in os.listdir(path):
        os.remove(f"{path}/{name}")
    with pytest.raises(FileNotFoundError):
        held.contains(np.arange(0, 2**64, 2**58, dtype=np.uint64))


def test_look_ups_of_hot_and_cold_keys(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 2500, F.lit(7)).when(F.col("id") % 2 == 0, F.col("id")).alias("k"))
    values = rows.groupBy("k").agg(F.count("*").alias("n")).where("k is not null and k <> 3000").select("k", (F.col("k") * 2).alias("v"), "n")
    found = {r["id"]: (r["k"], r["v"]) for r in looked_up(rows, values, "k").collect()}
    assert found == {i: (k, None if k is None or k == 3000 else 2 * k) for i in range(5000) for k in [7 if i < 2500 else i if i % 2 == 0 else None]}


def test_long_keys_are_not_kept():
    kept = Recent(len, 10)
    assert kept["a" * 1000] == 1000 and kept["abc"] == 3 and list(kept) == ["abc"]
    for i in range(100):
        assert kept[str(i)] == len(str(i)) and len(kept) + len(kept.older) <= 20


def test_slices_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"a": list(range(10)), "t": ["x" * 100] * 10})
    parts = list(slices([batch, batch.slice(0, 0)], rows=4, text_bytes=300))
    assert sum((p[0] for p in parts), []) == list(range(10)) and all(len(p[0]) <= 4 for p in parts)


def test_folds_of_ids(spark):
    rows = spark.createDataFrame([(7,), (None,), (123456,)], "i long").select("i", crc_fold(F.col("i")).alias("f")).collect()
    assert {r["i"]: r["f"] for r in rows} == {7: zlib.crc32(b"7") % 5, 123456: zlib.crc32(b"123456") % 5, None: 0}


def test_sets_without_keys_after_a_shuffle(spark):
    """Spark drops tasks over no rows, so that no file is written."""
    none = spark.range(100).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")).where("n > 1000")
    held = KeySet.store(none, 0)
    assert not held.contains(np.arange(10, dtype=np.uint64)).any() and held.values(np.arange(3, dtype=np.uint64), 5).tolist() == [5, 5, 5]


def test_sums_of_blocks(spark):
    rng = np.random.default_rng(3)
    some = KeySet("", 6)

    def blocks(batches):
        for batch in batches:
            for seed in batch.column("id").to_pylist():
                key, place = np.unique(mixed(np.random.default_rng(seed).integers(0, 500, 300).astype(np.uint64)), return_inverse=True)
                yield some.blocks_of(key, np.bincount(place) / 2)

    held = KeySet.summed(spark.range(0, 20, 1, 5).mapInArrow(blocks, "part int, data binary"), 6, 100)
    hand = np.bincount(np.concatenate([np.random.default_rng(s).integers(0, 500, 300) for s in range(20)]), minlength=500)
    assert held.values(mixed(np.arange(500, dtype=np.uint64)), -1).tolist() == np.where(hand > 0, np.rint(hand / 2), -1).tolist()
    assert not held.contains(mixed(rng.integers(500, 10_000, 100).astype(np.uint64))).any()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    folder = "/root/testdata/sf0.01"
    for t in ("embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    theirs = duck.execute(queries.oracle_sql()[name])
    mine = queries.queries()[name](spark, folder)
    assert mine.columns == [c[0] for c in theirs.description]
    assert sorted(map(tuple, mine.collect())) == sorted(theirs.fetchall())


def test_looked_up_takes_maps_repeated_rows_and_long_values(spark):
    rows = spark.range(0, 40_000, 1, 8).selectExpr("if(id % 2 = 0, null, id % 4000) as key", "'same' as text", "map('a', struct(1 as b)) as extra")
    rows = rows.unionByName(spark.range(20_000).selectExpr("7L as key", "'same' as text", "map('a', struct(1 as b)) as extra"))
    values = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).withColumn("v", F.repeat(F.lit("x"), (F.col("key") % 9).cast("int")))
    for size in (None, F.length("v") * 20_000):
        met = looked_up(rows, values, "key", size=size)
        assert met.columns == ["key", "text", "extra", "v"]
        assert met.where("key is not null and length(v) <> key % 9 or key is null and v is not null").count() == 0 and met.count() == 60_000
        busiest = met.groupBy(F.spark_partition_id()).count().agg(F.max("count") / F.avg("count")).first()[0]
        assert busiest < 3 if size is None else True
    assert looked_up(rows.where("false"), values, "key").count() == 0


def test_folders_go_when_discarded_and_when_the_application_ends(tmp_path):
    code = """
from pyspark.sql import SparkSession
from lamina.sources.tables import discard, folders, written
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "file://ROOT").config("spark.ui.enabled", "false").getOrCreate()
one, two = (written(spark.range(3)) for _ in range(2))
discard(spark, folders(spark)[:1])
print("left", len(folders(spark)), two.count())
"""
    done = subprocess.run([sys.executable, "-c", code.replace("ROOT", str(tmp_path))], capture_output=True, text=True, timeout=120, cwd=Path(__file__).resolve().parents[2])
    assert "left 1 3" in done.stdout, done.stderr[-2000:]
    for _ in range(100):
        if not list(tmp_path.glob("lamina-*")):
            return
        time.sleep(0.1)
    raise AssertionError(list(tmp_path.iterdir()))
