import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import negatives as N

KIND = "vec_id long, embedding array<double>, label int"


def by_hand(rows, scale=256, anchors=lambda i: i % 100 == 0):
    quantised = {}
    used = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            used.append((i, label, [int(np.floor(scale * x)) for x in v]))
    out = []
    for a, of, v in used:
        if not anchors(a) or a in quantised:
            continue
        quantised[a] = True
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, label == of) for i, label, w in used if i != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            within = [(n, i) for n, i, same in scored if not same and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(within, 1)]
    return sorted(out)


def vectors(seed, n=700, dims=6, labels=3):
    r = random.Random(seed)
    odd = [None, [None] * dims, [float("nan")] * dims, [float("inf")] * dims]
    return [(i * 5, r.choice(odd) if i % 41 == 3 else [r.choice([-0.5, 0.1, 0.25, 0.31, r.random()]) for _ in range(dims)], None if i % 53 == 2 else r.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("lane", [(4096, 262_144), (64, 64)])
def test_negatives_equal_brute_force(spark, lane):
    rows = vectors(1)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    found = N.hard_negatives(df, F.col("vec_id") % 100 == 0, lane=lane, chunk=(4, 4))
    assert sorted(map(tuple, found.collect())) == by_hand(rows)


def test_scores_of_zero_ties_and_negative_scores(spark):
    zero, up, down = [0.0, 1.0], [1.0, 0.0], [-1.0, 0.0]
    rows = [(0, up, 1), (9, zero, 1), (3, zero, 2), (12, zero, 2), (4, down, 2), (5, down, 1), (100, up, 3)]
    found = N.hard_negatives(spark.createDataFrame(rows, KIND), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, found.collect())) == by_hand(rows) == [(0, 9, 1, 3, 0, 0), (0, 9, 2, 12, 0, 0)]


def test_repeated_rows_are_candidates_each(spark):
    rows = [(0, [1.0], 1)] * 3 + [(7, [1.0], 1)] * 2 + [(8, [0.5], 2)] * 12 + [(9, [0.25], 2)]
    found = sorted(map(tuple, N.hard_negatives(spark.createDataFrame(rows, KIND), F.col("vec_id") == 0, lane=(4, 4)).collect()))
    assert found == sorted([(0, 7, k, 8, 65536, 32768) for k in range(1, 11)] * 2)


def test_huge_components_lengths_no_rows_and_odd_columns(spark):
    rows = [(0, [1e300, 1.0], 1), (1, [-1e300, 2.0], 1), (2, [0.0, 3.0], 2), (3, [1.0], 2), (4, [], 1)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as id", "map('a', 1) as vector", "'x' as asks")
    N.hard_negatives(df, F.col("vec_id") == 0).collect()
    assert N.hard_negatives(df.where("false"), F.col("vec_id") == 0).count() == 0
    assert N.hard_negatives(df, F.col("vec_id") < 0).count() == 0
    assert N.hard_negatives(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_an_iterator_keeps_the_windows_of_one_anchor():
    keys = iter([((1, -100, 0, 5), None), ((1, -60, 1, 6), None), ((2, -60, 1, 7), None), ((2, -50, 0, 8), None), ((2, -45, 1, 9), None)])
    assert list(N.mined(keys, (30, 90), 5, 10)) == [(1, 5, 1, 6, 100, 60), (2, 8, 1, 9, 50, 45)]
