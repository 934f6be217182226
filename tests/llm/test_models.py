import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import kneser_ney, neighbours, queries


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


class ByHand:
    """Interpolated modified Kneser-Ney of order 2 over dictionaries."""

    def __init__(self, texts):
        self.pairs = collections.Counter(p for t in texts for p in zip(["<s>", *words(t)], words(t), strict=False))
        self.count = collections.Counter(w for t in texts for w in words(t))
        self.spread = collections.Counter(w for _, w in self.pairs)
        levels = lambda c: [sum(x == n for x in c.values()) for n in (1, 2, 3, 4)]
        self.d, self.e = kneser_ney.discounts(levels(self.pairs)), kneser_ney.discounts(levels(self.spread))

    def lower(self, w):
        t = len(self.pairs)
        rest = sum(self.e[min(n, 3) - 1] for n in self.spread.values()) / t
        n = self.spread.get(w, 0)
        return (n - self.e[min(n, 3) - 1] if n else 0) / t + rest / (len(self.count) + 1)

    def p(self, v, w):
        after = {y: n for (x, y), n in self.pairs.items() if x == v}
        total = sum(after.values())
        if not total:
            return self.lower(w)
        n = after.get(w, 0)
        left = sum(self.d[min(x, 3) - 1] for x in after.values()) / total
        return (n - self.d[min(n, 3) - 1] if n else 0) / total + left * self.lower(w)


def test_scores_equal_dictionaries(spark, docs, texts):
    rng = np.random.default_rng(0)
    more = [(100 + i, " ".join(f"W{x}" for x in rng.zipf(1.5, 60) if x < 40), "s", "k") for i in range(30)] + [(99, "often " * 700, "s", "k")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    every = [*texts, *[m[1] for m in more]]
    model = kneser_ney.fit(docs, tokens=200)
    hand = ByHand(every)
    assert (model.tokens, model.vocabulary) == (sum(hand.count.values()), len(hand.count))
    new = spark.createDataFrame([(1000, "W1 never seen W2", "s", "k")], docs.schema)
    found = {r["doc_id"]: r for r in kneser_ney.score(docs.unionByName(new), model).collect()}
    for i, t in [*zip([r if r != 4 else None for r in range(len(texts))], texts, strict=True), *[m[:2] for m in more], (1000, "W1 never seen W2")]:
        w, r = words(t), found[i]
        n, v = model.tokens, model.vocabulary
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(hand.count[x] > 0 for x in w)
        assert r["base_score"] == pytest.approx(sum(math.log10((hand.count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert r["score"] == pytest.approx(sum(math.log10(hand.p(a, b)) for a, b in zip(["<s>", *w], w, strict=False)), rel=1e-9)
    assert sum(hand.p("w1", w) for w in [*hand.count, "unknown"]) == pytest.approx(1)


@pytest.mark.parametrize(("order", "hot"), [(3, 1024), (3, 2), (4, 4)])
def test_scores_of_higher_orders_equal_dictionaries(spark, order, hot):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, 50) if x < 12)) for i in range(60)] + [(60, "often " * 700), (61, None), (62, "")]
    levels = [collections.Counter() for _ in range(order + 1)]
    for _, t in rows:  # occurrences of all n-grams with one begin at most
        w = ["<s>", *words(t)]
        for n in range(1, order + 1):
            levels[n].update(g for g in zip(*[w[k:] for k in range(n)], strict=False) if g != ("<s>",))
    count = [None, *[collections.Counter() for _ in range(order)]]
    count[order] = levels[order]
    for n in range(1, order):
        count[n] = collections.Counter(g[1:] for g in levels[n + 1])
        count[n].update({g: c for g, c in levels[n].items() if g[0] == "<s>"})
    d = [None, *[kneser_ney.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]) for c in count[1:]]]
    after = collections.defaultdict(list)
    for n in range(1, order + 1):
        for g, c in count[n].items():
            after[g[:-1]].append(c)

    def p(context, w):
        n = len(context) + 1
        lower = p(context[1:], w) if context else 1 / (len(levels[1]) + 1)
        if not (total := sum(after.get(context, ()))):
            return lower
        c = count[n].get((*context, w), 0)
        return (c - d[n][min(c, 3) - 1] if c else 0) / total + sum(d[n][min(x, 3) - 1] for x in after[context]) / total * lower

    docs = spark.createDataFrame([*rows, (99, "w1 never seen w2 w1 w1 w3")], "doc_id long, text string")
    model = kneser_ney.fit(docs.where("doc_id <> 99"), tokens=200, order=order, hot=hot)
    found = {r["doc_id"]: r["score"] for r in kneser_ney.score(docs, model).collect()}
    for i, t in [*rows, (99, "w1 never seen w2 w1 w1 w3")]:
        w = ["<s>", *words(t)]
        assert found[i] == pytest.approx(sum(math.log10(p(tuple(w[max(0, k - order + 1) : k]), w[k])) for k in range(1, len(w))), rel=1e-9)
    assert sum(p(("w1", "w2"), w[0]) for w in [*levels[1], ("unknown",)]) == pytest.approx(1)


def test_no_training_texts(spark, docs):
    model = kneser_ney.fit(docs.where("false"))
    assert {(r["score"], r["base_score"]) for r in kneser_ney.score(docs, model).collect()} == {(0.0, 0.0)}
    assert kneser_ney.score(docs.where("false"), model).count() == 0
    grouped = docs.groupBy("doc_id").agg(F.first("text").alias("text"), F.count("*").alias("n")).where("n > 100")
    assert {r["score"] for r in kneser_ney.score(docs, kneser_ney.fit(grouped, order=3)).collect()} == {0.0}


def test_nearest_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((600, 64)) * rng.random((600, 1)) * 3
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)]
    rows += [(1000, None, "x"), (1020, [0.0] * 64, "x"), (1040, [float("nan")] * 64, "x"), (1060, [None] * 64, "x"), (1080, [1.0], "x"), (None, [1.0] * 64, "x"), (601, v[3].tolist(), "x"), (602, v[3].tolist(), "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    found = collections.defaultdict(list)
    for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0, lane=(100, 100), chunk=(16, 16)).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array([*range(600), 601, 602])
    every = np.concatenate([v, v[[3, 3]]]).astype(np.float32).astype(float)
    assert set(found) == set(range(0, 600, 20))
    right = 0
    for q, got in found.items():
        s = every @ every[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21))
        for _, i, score in got:
            assert score == pytest.approx(float(s[np.flatnonzero(ids == i)[0]]), rel=1e-12)
        right += len({g[1] for g in got} & {int(ids[i]) for i in order})
    assert right >= 0.98 * 20 * len(found)
    assert neighbours.nearest(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(table.where("vec_id in (0, 1)"), F.col("vec_id") % 20 == 0).count() == 1
    assert neighbours.nearest(table.where("vec_id in (1, 2)"), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(table.where("vec_id in (1, 1080)"), F.col("vec_id") % 20 == 0).count() == 0
    grouped = table.groupBy("vec_id").agg(F.first("embedding").alias("embedding"), F.count("*").alias("n")).where("n > 100")
    assert neighbours.nearest(grouped, F.col("vec_id") % 20 == 0).count() == 0


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hits = total = 0
    found = collections.defaultdict(set)
    for r in queries.op4_one_bit_neighbours(spark, sf).collect():
        found[r["query_id"]].add(r["vec_id"])
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        best = [int(ids[j]) for j in np.argsort(-s) if j != i][:20]
        hits += len(found[int(ids[i])] & set(best))
        total += 20
    assert hits / total >= 0.95
