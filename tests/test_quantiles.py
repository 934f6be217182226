import math

import duckdb
import numpy as np
import pytest

from lamina.operators import ink, textlayers
from lamina.plans import catalog

#: Pixels whose light at the quantile's two ends is next to each other: 127.59039999999999 and 127.5904; 126.63959999999999 and 126.6396.
CASES = {
    1: ([(107, 135, 84), (148, 134, 4), (100, 141, 76), (162, 135, 44)], (128, 134, 44)),
    2: ([(94, 113, 144), (146, 108, 212), (102, 131, 156), (150, 124, 84), (94, 161, 112)], (120, 110, 178)),
}


def test_ink_colours_with_light_next_to_the_quantile(spark):
    rows = [(image, 0, x, *rgb) for image, (px, _) in CASES.items() for x, rgb in enumerate(px)]
    pixels = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int")
    found = {r["image_id"]: (r["r"], r["g"], r["b"]) for r in ink.ink_colours(pixels, "image_id").collect()}
    assert found == {image: colour for image, (_, colour) in CASES.items()}


@pytest.mark.parametrize("share", [0.45, 0.6, 0.75])
def test_quantiles_are_those_of_sql(spark, share):
    rng = np.random.default_rng(3)
    groups = [rng.integers(0, 256, (n, 3)) @ np.array([0.2126, 0.7152, 0.0722]) for n in rng.integers(1, 40, 200)]
    groups += [np.array([v, math.nextafter(v, 300), v]) for v in rng.random(50) * 255]
    groups += [np.full(n, 123.456) for n in range(1, 10)]
    rows = [(k, np.sort(v).tolist()) for k, v in enumerate(groups)]
    theirs = [duckdb.execute(f"SELECT quantile_cont(v, {share}) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [v]).fetchone()[0] for _, v in rows]
    mine = ink.with_quantile(spark.createDataFrame(rows, "k long, v array<double>"), "v", share, "q").orderBy("k").collect()
    assert [r["q"] for r in mine] == theirs
    assert [textlayers.quantile(np.array(v), share) for _, v in rows] == theirs


#: Shades of three vectors, side by side: the first part of their word has light of two colours next to each other at its quantile's ends.
SIDE_BY_SIDE = [
    "6fcb8c8775837d88798082618782756f6b95749b9a90759473688b7e7d91746f7970717c94727a847c737e8f8176839d757a8683998888918eac708c926d91a2",
    "728a7a629470907692a06a857886777c86889c7e817b8e8778706289a98d82907b7a8f946d60878998748b8a7c7d8a72779a887c84729577746e8787637a8398",
    "8873908b7f808c9e85756a888e83608976778d836a747c8e757e73837b7e638178829d7e978477897673719a85867f915c897a5f686a6f5f7a8c8894757a5b8d",
]


def test_split_words_with_light_next_to_the_quantile(spark, tmp_path):
    vectors = [((np.frombuffer(bytes.fromhex(v), np.uint8) + 0.5) / 127.5 - 1).tolist() for v in SIDE_BY_SIDE]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").selectExpr("*", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        theirs = c.execute(f"SELECT run, text, r, g, b FROM ({catalog.SQL['lyr_7_split_words']})").fetchall()
    mine = catalog.QUERIES["lyr_7_split_words"](spark, str(tmp_path)).select("run", "text", "r", "g", "b").collect()
    assert theirs and sorted(map(tuple, mine)) == sorted(theirs)
