import duckdb
import numpy as np
import pytest

from lamina.plans import catalog


@pytest.mark.parametrize("name", ["lyr_7_split_words", "evl_1_composite"])
@pytest.mark.parametrize("odd", ["null", "short", "long"])
def test_images_of_odd_vectors(spark, tmp_path, name, odd):
    """Every third vector is null, lacks components or has too many; the others have so much ink that their paper decides on the background."""
    rng = np.random.default_rng(2)
    vectors = np.where(rng.random((60, 64)) < 0.7, rng.random((60, 64)) / 2 + 0.2, 0.1).tolist()
    for k in range(2, 60, 3):
        vectors[k] = {"null": None, "short": vectors[k][:k], "long": vectors[k] + vectors[k][:9]}[odd]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT *, 0 AS label FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        mine = catalog.QUERIES[name](spark, str(tmp_path))
        columns = ", ".join(f'"{k}"' for k in mine.columns)
        theirs = c.execute(f"SELECT {columns} FROM ({catalog.SQL[name]})").fetchall()
    assert theirs and sorted(map(tuple, mine.collect())) == sorted(theirs)
