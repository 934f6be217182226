import duckdb
import numpy as np
import pytest

from lamina.model import SegmentOptions
from lamina.plans import catalog, engine
from lamina.sources import derived


#: First ids of twelve images each: neighbours beyond 2 ** 53 are the same double, and those around zero are divided towards it.
@pytest.mark.parametrize("first", [0, -12, -5, 2**53 + 1, 10**17 + 1, -(10**17)])
def test_split_words_of_any_ids(spark, tmp_path, first):
    vectors = np.random.default_rng(4).standard_normal((12, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    spark.createDataFrame([(first + k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT *, 0 AS label FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        theirs = c.execute(f'SELECT image_id, line_no, run, text, start, "end", r, g, b FROM ({catalog.SQL["lyr_7_split_words"]})').fetchall()
    mine = catalog.QUERIES["lyr_7_split_words"](spark, str(tmp_path)).select("image_id", "line_no", "run", "text", "start", "end", "r", "g", "b").collect()
    assert theirs and sorted(map(tuple, mine)) == sorted(theirs)


def test_images_of_cases_with_any_ids(spark):
    ids, cases = [0, 7, -4, 2**53 + 1, 10**17 + 1], engine.Cases([engine.Candidate(name, SegmentOptions()) for name in "abc"])
    rows = spark.createDataFrame([(i, i * 3 + place) for i in ids for place in range(3)], "own long, image_id long")
    assert [r for r in rows.select("own", cases.image().alias("image")).collect() if r["own"] != r["image"]] == []


def test_votes_of_any_users(spark, tmp_path):
    users = [(k, u) for k, u in enumerate([0, 9, -1, -7, 2**53 + 1, 10**17 + 4])]
    spark.createDataFrame(users, "event_id long, user_id long").selectExpr("*", "'click' AS event_type", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    theirs = duckdb.execute(f"WITH events AS (SELECT * FROM '{tmp_path}/events.parquet/*.parquet'), {derived.VOTES} SELECT model_ord, image_id FROM v").fetchall()
    assert sorted(map(tuple, derived.votes(spark, str(tmp_path)).select("model_ord", "image_id").collect())) == sorted(theirs)
