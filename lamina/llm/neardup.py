"""Near-duplicate classes of documents by ProbMinHash, banding and verification.

Shingles are runs of five words (all words, where there are fewer), weighted by 1 + ln(count). Each shingle is a
Poisson process at the rate of its weight; its arrivals go to random registers, and a register keeps the shingle that
arrives first. Two documents agree in a register with the probability Jaccard similarity of their weights. A shingle's
process ends when it is later than all registers of the document. Bands of registers give candidates, which are
verified: documents are linked if their sets of shingles have a Jaccard similarity of at least the threshold, and
classes are the components of the links. Since counts play no part in that, a document with repeated shingles also has
the bands of its set (weights of 1), which are all the bands of one without; two documents are candidates if they share
any band.

Documents of the same words are one node. A bucket of few nodes gives pairs, each verified once. A crowded one is
dealt to blocks, each of which returns links that connect the same nodes as all links within it would; a node goes to
blocks of a few of its crowded buckets, and each bucket is cut differently, so that blocks of one connect those of
another. Components are then formed, and only buckets that still hold several of them are looked at again: the nodes
outside a bucket's main component meet all others, block by block, and return at most one link for each pair of
components. No link between different texts is lost, and no task gets a whole group. Of texts that are near copies of
each other, rows and links grow with the nodes. Of texts that share a template, without being near copies, and so a
crowded bucket, the second look meets all pairs of blocks: that work grows with the square of the bucket.

A document is a row with a non-null id. Rows with a null id have a null class. A null text counts as empty; a text
without words is a class of its own. Repeated rows are copies. Other columns are not looked at; an empty table gives
an empty one. Node ids are 64-bit hashes of the words, compared shingles 32-bit ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import KeySet, free_name, looked_up, slices, written
from lamina.llm.components import connected_components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
CROWD, BLOCK = 16, 256
#: Crowded buckets that a node is compared in at first: those with the least hashes, so that alike nodes choose the same ones.
FIRST = 4
U = np.uint64
MULTIPLIER = U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer."""
    x = x + MULTIPLIER
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def powers(n: int = 1 << 16) -> np.ndarray:
    out = np.full(n, U(0x100000001B3 | 0x9E3779B100000000), U)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word (lower case, runs of letters and digits)."""
    lowered = [t.lower() for t in texts]
    c = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word_characters()[c]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, U), np.empty(0, np.int64)
    length = end - start
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    value = (c[inside].astype(U) + U(1)) * powers()[place & 0xFFFF] + (place >> 16).astype(U)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), start, side="right")
    return mixed(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(U)), owner


def shingles(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each distinct shingle, by text and hash; and a hash of each text's words (0: none)."""
    word, owner = word_hashes(texts)
    count = np.bincount(owner, minlength=len(texts))
    whole = np.zeros(len(texts), U)
    if not len(word):
        return np.empty(0, np.int64), np.empty(0, U), np.empty(0, np.int64), whole
    first = np.cumsum(count) - count
    place = (np.arange(len(word)) - first[owner]).astype(U)
    has = count > 0
    whole[has] = mixed(np.add.reduceat(mixed(word + place * MULTIPLIER), first[has]))
    run = np.zeros(max(0, len(word) - n + 1), U)
    for k in range(n):
        run = mixed(run + word[k : len(word) - n + 1 + k])
    same = owner[: len(run)] == owner[n - 1 :] if len(run) else np.empty(0, bool)
    few = has & (count < n)
    doc = np.concatenate([owner[: len(run)][same], np.flatnonzero(few)])
    key = np.concatenate([run[same], whole[few]])
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
    at = np.flatnonzero(new)
    return doc[at], key[at], np.diff(np.concatenate([at, [len(doc)]])), whole


def prob_min_hash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """The shingle that each register of each document keeps; 0 in documents without shingles."""
    time = np.full(n_docs * registers, np.inf)
    kept = np.zeros(n_docs * registers, U)
    reached = np.zeros(len(doc))
    number = 0
    while len(doc):
        several = int(min(64, max(1, 100_000 // len(doc))))
        at = reached
        for step in range(number, number + several):
            draw = mixed(key + U((step + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
            at = at - np.log(((draw >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
            slot = doc * registers + (mixed(draw) % U(registers)).astype(np.int64)
            earlier = at < time[slot]
            if earlier.any():
                s, t, k = slot[earlier], at[earlier], key[earlier]
                order = np.lexsort((k, t, s))
                s, t, k = s[order], t[order], k[order]
                one = np.concatenate([[True], s[1:] != s[:-1]])
                time[s[one]], kept[s[one]] = t[one], k[one]
        number += several
        own = np.unique(doc)
        last = np.zeros(n_docs)
        last[own] = time.reshape(n_docs, registers)[own].max(axis=1)
        on = at < last[doc]
        doc, key, weight, reached = doc[on], key[on], weight[on], at[on]
    return kept.reshape(n_docs, registers)


def texts_of(docs: DataFrame, text: str, key: str) -> DataFrame:
    """id, digest (of the text as it is) and text (null: empty) of each row."""
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def banded(kept: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The hash of each band of registers, by document."""
    band = np.zeros((len(kept), bands), U)
    for r in range(rows):
        band = mixed(band + kept[:, r::rows])
    return mixed(band + np.arange(bands, dtype=U))


def sketched(docs: DataFrame, text: str, key: str, bands: int, rows: int, n: int) -> DataFrame:
    """id, digest, node (null: no words) and bands of each row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, digests, texts in slices(batches, 256, 2 << 20):
            doc, run, count, whole = shingles(texts, n)
            band = banded(prob_min_hash(doc, run, 1 + np.log(count), len(texts), bands * rows), bands, rows)
            repeats = np.zeros(len(texts), bool)
            repeats[doc[count > 1]] = True
            on = repeats[doc]
            number = np.cumsum(repeats) - 1
            as_set = banded(prob_min_hash(number[doc[on]], run[on], np.ones(int(on.sum())), int(repeats.sum()), bands * rows), bands, rows)
            every = [np.unique([x, as_set[number[i]]]) if repeats[i] else x for i, x in enumerate(band)]
            edges = np.cumsum([0, *map(len, every)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(every).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array(whole.view(np.int64), mask=whole == 0), lists], names=["id", "digest", "node", "bands"])

    return texts_of(docs, text, key).mapInArrow(sketch, "id long, digest long, node long, bands array<bigint>")


def placed(nodes: DataFrame, buckets: KeySet) -> DataFrame:
    """node, bucket and the bucket's value, for those buckets of the set that hold the node."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("bands")
            each = np.diff(np.asarray(lists.offsets))
            band = np.asarray(lists.flatten()).view(U)
            on, value = buckets.found(band)
            node = np.repeat(np.asarray(batch.column("node")), each)
            yield pa.RecordBatch.from_pydict({"node": pa.array(node[on]), "bucket": pa.array(band[on].view(np.int64)), "size": pa.array(value[on])})

    return nodes.select("node", "bands").mapInArrow(found, "node long, bucket long, size long").distinct()


def shingle_sets(docs: DataFrame, text: str, key: str, n: int, nodes: KeySet) -> DataFrame:
    """node and shingles (binary: sorted 32-bit) of the nodes in the set. Words are hashed again, which takes less than keeping all shingles."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in slices(batches, 256, 2 << 20):
            doc, run, _, whole = shingles(texts, n)
            on = np.flatnonzero((whole != 0) & nodes.contains(whole))
            short = (run >> U(32)).astype("<u4")
            edge = np.searchsorted(doc, np.arange(len(texts) + 1))
            sets = [np.unique(short[edge[i] : edge[i + 1]]).tobytes() for i in on]
            yield pa.RecordBatch.from_pydict({"node": pa.array(whole[on].view(np.int64)), "shingles": pa.array(sets, pa.binary())})

    return texts_of(docs, text, key).select("text").mapInArrow(found, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def jaccard(a: bytes, b: bytes, least: float = 0.0) -> float:
    """Similarity of two sets; where their sizes keep it below the least one of interest, a bound that is below it too."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    bound = min(len(x), len(y)) / max(1, len(x), len(y))
    if bound < least or not bound:
        return bound
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def linked_pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b of the pairs (a, b, sa, sb) that are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = [jaccard(x, y, threshold) >= threshold for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def similar_sets(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets are similar to which. Overlaps of all sets at once, as products of membership matrices."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), size)
    value, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    on = shared[place]
    owner, column = owner[on], number[place[on]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((m, m), np.float32)
    for at in range(0, int(shared.sum()), 8192):
        part = slice(*np.searchsorted(column, [at, at + 8192]))
        member = np.zeros((m, min(8192, int(shared.sum()) - at)), np.float32)
        member[owner[part], column[part] - at] = 1
        common += member @ member.T
    similar = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6
    np.fill_diagonal(similar, False)
    return similar


def spanning_links(sets: list[np.ndarray], threshold: float, known: np.ndarray) -> list[tuple[int, int]]:
    """Places of similar sets, as few pairs as connect what all pairs of similar sets would; known: the component of each set, within which no pair is needed."""
    similar = similar_sets(sets, threshold)
    same = known[:, None] == known[None, :]
    out, seen = [], np.zeros(len(sets), bool)
    for root in range(len(sets)):
        if seen[root]:
            continue
        seen[root] = True
        stack = [root]
        while stack:
            i = stack.pop()
            one = np.flatnonzero(same[i] & ~seen)
            seen[one] = True
            stack += one.tolist()
            for j in np.flatnonzero(similar[i] & ~seen):
                if not seen[j]:
                    out.append((i, int(j)))
                    one = np.flatnonzero(same[j] & ~seen)
                    seen[one] = True
                    stack += one.tolist()
    return out


def block_links(rows: DataFrame, threshold: float, *group: str) -> DataFrame:
    """a, b: links between components within each group of rows (component, shingles)."""

    def links(rows: pa.Table) -> pa.Table:
        component = rows.column("component").to_numpy()
        _, known = np.unique(component, return_inverse=True)
        found = [] if not known.any() else spanning_links([np.frombuffer(x, "<u4") for x in rows.column("shingles").to_pylist()], threshold, known)
        return pa.table([pa.array([component[x[k]] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.select(*group, "component", "shingles").groupBy(*group).applyInArrow(links, "a long, b long")


def dealt(size: Column, block: int) -> Column:
    """A block for each node of so many, by the hash of node and bucket: buckets that hold the same nodes are cut differently, so that their blocks connect each other's."""
    return F.pmod(F.xxhash64("node", "bucket"), F.greatest(F.lit(1), F.ceil(size / block))).cast("int")


def links_across(crowded: DataFrame, sets: DataFrame, components: DataFrame, threshold: float, block: int) -> DataFrame | None:
    """Links between the components that a crowded bucket (bucket, size, node) still holds, or None if none holds several.

    The nodes of a bucket's main component are dealt to blocks, and so are all others, which meet each other and these.
    """
    member = written(crowded.join(components, "node", "left").withColumn("component", F.coalesce("component", "node")))
    held = member.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    sizes = held.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main"))
    sizes = written(sizes.select("bucket", "n", F.col("main.component").alias("main"), F.col("main.n").alias("inner"), (F.col("n") - F.col("main.n")).alias("outer")))
    if not sizes.where("outer > 0").limit(1).count():
        return None
    rows = looked_up(member, sizes, "bucket").where("outer > 0")
    inside = F.col("component") == F.col("main")
    own, outer_blocks, inner_blocks = F.when(inside, dealt(F.col("inner"), block)).otherwise(dealt(F.col("outer"), block)), F.ceil(F.col("outer") / block).cast("int"), F.ceil(F.col("inner") / block).cast("int")
    rows = rows.withColumn("own", own)
    # i is a block of outer nodes; j one of inner nodes (from 0 on) or of outer nodes (below 0).
    number = lambda n: F.sequence(F.lit(0), n - 1)
    with_inner = F.when(inside, F.transform(number(outer_blocks), lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))).otherwise(F.transform(number(inner_blocks), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))))
    with_outer = F.when(inside, F.expr("cast(array() as array<struct<i: int, j: int>>)")).otherwise(F.transform(number(outer_blocks), lambda k: F.struct(F.least(k, "own").alias("i"), (-1 - F.greatest(k, F.col("own"))).alias("j"))))
    rows = rows.select("bucket", "node", "component", F.explode(F.concat(with_inner, with_outer)).alias("at")).select("bucket", "node", "component", "at.i", "at.j")
    return block_links(rows.join(sets, "node"), threshold, "bucket", "i", "j").distinct()


def similar_components(docs: DataFrame, table: DataFrame, text: str, key: str, threshold: float, words: int, crowd: int, block: int) -> DataFrame:
    """node and component (the smallest node) of every node with a link. table: of sketched()."""
    nodes = table.where("node is not null")
    distinct = nodes.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("bucket"))
    sizes = written(distinct.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high")).where("size > 1"))
    # Most shared buckets hold two nodes, which the aggregate names; the nodes of larger ones are looked up.
    two = sizes.where("size = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    large = sizes.where("size > 2").select("bucket", "size")
    larger = written(placed(nodes, KeySet.store(large, large.count())))
    few = larger.where(F.col("size") <= crowd).groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    few = few.select(F.explode(F.expr("flatten(transform(nodes, (x, i) -> transform(slice(nodes, i + 2, size(nodes)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    pairs = written(two.unionByName(few).distinct())
    crowded = larger.where(F.col("size") > crowd)
    wanted = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(crowded.select("node")).distinct())
    sets = written(shingle_sets(docs, text, key, words, KeySet.store(wanted, wanted.count())))
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    nth = F.row_number().over(Window.partitionBy("node").orderBy("bucket"))  # BANDS rows a node, or twice as many
    first_ones = crowded.withColumn("nth", nth).where(F.col("nth") <= FIRST).drop("nth")
    within = first_ones.join(sets, "node").withColumn("component", F.col("node")).withColumn("own", dealt(F.col("size"), block))
    components = connected_components(linked_pairs(both, threshold).unionByName(block_links(within, threshold, "bucket", "own")))
    across = links_across(crowded, sets, components, threshold, block)
    if across is None:
        return components
    return connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(across))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """id, digest (xxhash64 of the text) and first, the least (nameless, id, digest) of its class, of each row; nameless: 1 for a null id, which so comes last."""
    table = written(sketched(docs, text, key, bands, rows, words))
    components = similar_components(docs, table, text, key, threshold, words, crowd, block)
    own = F.struct(F.col("id").isNull().cast("int").alias("nameless"), "id", "digest")
    nodes = written(table.where("node is not null").groupBy("node").agg(F.min(own).alias("least"), F.count("*").alias("n")))
    linked = written(nodes.join(components, "node"))
    of_component = linked.groupBy("component").agg(F.min("least").alias("first"), F.count("*").alias("n"))
    named = looked_up(linked, of_component, "component").select("node", "first", "n")
    alone = nodes.where("n > 1").join(components, "node", "left_anti").select("node", F.col("least").alias("first"), "n")
    found = looked_up(table.select("id", "digest", "node"), written(named.unionByName(alone)), "node")
    return found.select("id", "digest", F.coalesce("first", own).alias("first"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """key and class_id (the smallest key of the class) of each row. how: threshold and the others of classes()."""
    found = classes(docs.where(F.col(key).isNotNull()), text, key, **how).select(F.col("id").alias(key), F.col("first.id").alias("class_id"))
    nameless = docs.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias(key), F.lit(None).cast("long").alias("class_id"))
    return found.unionByName(nameless)


def one_of_each_class(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, one for each class: the one with the smallest id (null ids last), ties by the text's hash; of rows with one id and text any one.

    Rows are told apart by id and text, so that an id that stands on several texts, or on none, decides for no other text.
    """
    names = docs.columns
    id_, digest, nth = (free_name(names, x) for x in ("row_id", "row_digest", "row_nth"))
    same = Window.partitionBy(id_, digest).orderBy(id_)
    rows = docs.withColumn(id_, F.col(key).cast("long")).withColumn(digest, F.xxhash64(text)).withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1)
    first = classes(docs, text, key, **how).select(F.col("first.id").alias("first_id"), F.col("first.digest").alias("first_digest")).distinct()
    on = rows[id_].eqNullSafe(first["first_id"]) & (rows[digest] == first["first_digest"])
    return rows.join(first, on, "left_semi").select(*names)


def expected_miss(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that two documents whose sets have this Jaccard similarity share no band."""
    return math.pow(1 - similarity**rows, bands)
