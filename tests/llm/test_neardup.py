import collections
import re

import numpy as np

from lamina.llm import neardup
from lamina.llm.components import connected_components


def word_sets(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes_by_hand(rows, threshold=0.8):
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, word_sets(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and len(a & b) >= threshold * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: top(i) for i, _ in rows}


def corpus(seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for group in (1, 1, 1, 2, 3, 5, 40, 1, 2):
        base = list(rng.choice(words, 150))
        for k in range(group):
            own = list(base)
            for p in rng.integers(0, 150, k % 7):
                own[p] = "edit%d" % rng.integers(1e6)
            rows.append((i, " ".join(own) + "."))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "a b"), (i + 3, "A, b!"), (i + 4, "..."), (i + 5, rows[0][1].upper()), (i + 6, " ".join(rng.choice(words, 20000)))]
    return rows


def test_classes(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs, crowd=4, block=8).collect()}
    assert found == classes_by_hand(rows)


def test_nulls_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    found = collections.Counter((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(docs).collect())
    assert found == {(None, None): 2, (2, 1): 2, (1, 1): 1}
    assert neardup.near_duplicates(docs.where("false")).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    a, b = rng.random(60) + 0.2, rng.random(60) + 0.2
    a[:10], b[50:] = 0, 0
    both = (a > 0) & (b > 0)
    expected = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in np.flatnonzero(both))
    key = rng.integers(0, 2**63, 60).astype(np.uint64)
    doc = np.repeat([0, 1], 60)
    on = np.concatenate([a, b]) > 0
    kept = neardup.prob_min_hash(doc[on], np.concatenate([key, key])[on], np.concatenate([a, b])[on], 2, 4000)
    assert abs((kept[0] == kept[1]).mean() - expected) < 0.03


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 200).selectExpr("id * 7919 % 200 as x", "(id + 1) * 7919 % 200 as y").selectExpr("x as a", "y as b")
    rows = connected_components(links).collect()
    assert {r["component"] for r in rows} == {min(r["node"] for r in rows)}
    assert neardup.expected_miss(0.8) < 1e-3


def test_repeats_that_differ_in_number(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        words = [f"d{i}w{k}" for k in rng.permutation(1000)[:50]]
        line = " ".join(f"d{i}r{k}" for k in range(10))
        rows += [(2 * i, " ".join([*words, line])), (2 * i + 1, " ".join([*words, *[line] * 200]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hand = classes_by_hand([(i, t) for i, t in rows])
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()} == hand
    assert all(hand[2 * i + 1] == 2 * i for i in range(40))


def crowd(n, edits, words=120, seed=8):
    """n texts that each differ from one text in up to so many words."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for p in rng.choice(words, rng.integers(0, edits + 1), replace=False):
            own[p] = f"edit{rng.integers(1e6)}"
        out.append((i, " ".join(own)))
    return out


def test_links_of_a_crowd_grow_with_its_nodes(spark, monkeypatch):
    taken = []
    whole = neardup.connected_components
    monkeypatch.setattr(neardup, "connected_components", lambda links: taken.append(links.distinct().count()) or whole(links))
    for edits in (3, 6):
        rows = crowd(300, edits)
        taken.clear()
        found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), crowd=4, block=32, bands=64, rows=3).collect()}
        assert found == classes_by_hand(rows)
        nodes = len({t for _, t in rows})
        assert sum(taken) <= 8 * nodes


def test_rows_of_blocks_grow_with_the_nodes(spark, monkeypatch):
    rows_in = []
    whole = neardup.block_links
    monkeypatch.setattr(neardup, "block_links", lambda rows, *how: rows_in.append(rows.count()) or whole(rows, *how))
    for n in (1600, 3200):
        rows_in.clear()
        rows = crowd(n, 3, words=500)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
        assert {r["class_id"] for r in neardup.near_duplicates(docs).select("class_id").distinct().collect()} == {0}
        assert sum(rows_in) <= 40 * n


def test_spanning_links_respect_what_is_known():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.choice(400, 12)).astype("<u4") for _ in range(60)]
    known = rng.integers(0, 25, 60)

    def top(pairs):
        up = list(range(60))
        root = lambda i: i if up[i] == i else root(up[i])
        for i, j in pairs:
            a, b = sorted((root(i), root(j)))
            up[b] = a
        return [root(i) for i in range(60)]

    same = [(i, j) for i in range(60) for j in range(i) if known[i] == known[j]]
    for threshold in (0.02, 0.05, 0.1):
        all_ = [(i, j) for i in range(60) for j in range(i) if len(set(sets[i]) & set(sets[j])) >= threshold * len(set(sets[i]) | set(sets[j]))]
        few = neardup.spanning_links(sets, threshold, known)
        assert top(few + same) == top(all_ + same) and len(few) < len(set(known))


def test_similarities_below_half_are_verified(spark):
    a, b = " ".join(f"x{i}" for i in range(40)), " ".join(f"x{i}" for i in range(18))
    rows = [(1, a), (2, b), (3, " ".join(f"x{i}" for i in range(40, 60)) + " " + a)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.45, bands=64, rows=1)
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == classes_by_hand(rows, 0.45) == {1: 1, 2: 2, 3: 1}
