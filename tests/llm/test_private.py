import collections
import hashlib
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import private

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_hand(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(PATTERNS).index(kind), m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.1205-+ ()%é", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert private.base_spans(text) == by_hand(text)


@pytest.mark.parametrize("text", ["a@b.c_d@e.f g@h", "a@b@c.d", "x.@y.z.", "1.2.3.4.5.6.7.8", "0001.002.3.256 00255.1.1.1", "4845168114407329 4845-1681-1440-7329 2353820953013749", "+1 (017) 555-7713 2353820953013749 +44 20 7946 0958", "é 49@mail.example.com"])
def test_base_spans_of_cases(text):
    assert private.base_spans(text) == by_hand(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "+" * 300_000, "+1" + "(" * 300_000, "@" * 300_000, "1." * 150_000, "1 " * 150_000])
def test_long_runs_take_linear_time(text):
    private.base_spans(text)


def test_spans_and_sanitised_texts(spark, docs, texts):
    filler = [(100 + i, f"plain words number{i} of common speech here", "s", "k") for i in range(40)]
    told = [(200 + i, f"common speech here then zorblax reach me a.b@c.example.com common words {i}", "s", "k") for i in range(3)]
    docs = docs.unionByName(spark.createDataFrame([*filler, *told, told[0]], docs.schema))
    found = private.find_private(docs).collect()
    assert len(found) == len(texts) + len(filler) + len(told) + 1
    rows = {r["doc_id"]: r for r in found}
    for i, t in enumerate(texts):
        r, spans = rows[i if i != 4 else None], by_hand(t or "")
        shown = ",".join(f"{private.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == n for _, k, _ in spans) for n in range(4)]
        assert set(shown.split(",")) <= set(r["spans"].split(","))
    at = told[0][1].index("zorblax")
    assert f"removed:{at}:{at + 7}" in rows[200]["spans"] and rows[100]["spans"] == ""
    clean = {r["doc_id"]: r for r in private.sanitise(docs).collect()}
    assert "zorblax" not in clean[200]["text"] and "[email] common words" in clean[200]["text"] and clean[200]["key"] == "k"
    assert all(clean[i]["text"] == t for i, t, *_ in filler) and clean[0]["text"] is None
    assert private.find_private(docs.where("false")).count() == 0 and private.sanitise(docs.where("false")).count() == 0


def test_values_within_longer_runs_of_digits_are_found_too():
    card, phone = "4845168114407329", "+1 (017) 555-7713"
    assert private.luhn(card)
    text = f"see {card} 123456789012345 or {phone} {card} or 2001 2002 2003 2004 2005 2006"
    assert private.base_spans(text) == by_hand(text) == []
    assert {text[a:b] for a, _, b in private.all_spans(text)} == {card, phone}
    assert private.sanitised(text, private.all_spans(text)).count("[") == 3


def test_terms_near_a_value_that_one_text_names(spark):
    filler = [(i, f"we met the doctor and then wrote to all of them about case{i}") for i in range(2000)]
    told = "we met the quibblefrotz doctor anna.b@c.example.com and then wrote to all"
    rows = [*filler, *[(5000 + i, told) for i in range(6)], (6000, "the quibblefrotz story"), (7000, "met vexillator at one.two@c.example.com then")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"].split(",") for r in private.find_private(docs).collect()}
    place = lambda text, term: f"{text.index(term)}:{text.index(term) + len(term)}"
    for i in range(6):  # six copies are one text: the term stands in two, the value in one
        assert [x for x in found[5000 + i] if x[:5] != "email"] == ["term:" + place(told, "quibblefrotz")]
    assert "removed:" + place(rows[-1][1], "vexillator") in found[7000]
    assert found[0] == found[6000] == [""]


def terms_by_hand(texts, near, disclosure, removal):
    """Spans of terms of each distinct text by dictionaries, for texts of ASCII words whose only values are e-mail addresses."""
    texts = sorted(set(texts))
    df, named, co, places = (collections.defaultdict(set) for _ in range(4))
    for k, t in enumerate(texts):
        values = [m.span() for m in re.finditer(PATTERNS["email"], t)]
        free = [m.span() for m in re.finditer("[a-z0-9]+", t) if not any(a < m.end() and m.start() < b for a, b in values)]
        for w in re.findall("[a-z0-9]+", t):
            df[w].add(k)
        for a, b in values:
            e = t[a:b]
            named[e].add(k)
            before, after = [x for x in free if x[1] <= a][-near:], [x for x in free if x[0] >= b][:near]
            for x in before + after:
                co[e, t[slice(*x)]].add(k)
                places[k, e, t[slice(*x)]].add(x)
    out = collections.defaultdict(dict)
    for (k, e, w), at in places.items():
        content = math.log2(len(texts) / len(named[e]))
        if content > 0:
            share = (content - math.log2(len(df[w]) / len(co[e, w]))) / content
            for x in at:
                out[texts[k]][x] = max(share, out[texts[k]].get(x, 0))
    return {t: sorted(("removed" if s >= removal else "term", *x) for x, s in found.items() if s >= disclosure) for t, found in out.items()}


def test_terms_equal_dictionaries(spark):
    rng = np.random.default_rng(9)
    texts = []
    for i in range(300):
        words = [f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, 25), 400)]
        for _ in range(rng.integers(0, 3)):
            words.insert(int(rng.integers(0, len(words))), f"m{rng.integers(0, 40)}@x.org")
        texts.append(" ".join(words))
    texts += texts[:30] * 3
    docs = spark.createDataFrame([(i % 200 if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    hand = terms_by_hand(texts, 4, 0.4, 0.7)
    found = private.find_private(docs, near=4, disclosure=0.4, removal=0.7).select("doc_id", "spans").collect()
    shown = sorted(",".join(x for x in r["spans"].split(",") if x[:5] != "email") for r in found)
    assert shown == sorted(",".join(f"{k}:{a}:{b}" for k, a, b in sorted(hand.get(t, []), key=lambda x: x[1])) for t in texts)
    assert sum(map(len, hand.values())) > 100 and {k for s in hand.values() for k, *_ in s} == {"term", "removed"}


def test_generalised_terms_name_their_class():
    assert [private.generalised(t) for t in ("4711", "7", "x25", "Zorblax", "quux")] == ["4xxx", "x", "[code]", "[name]", "[word]"]
    assert private.sanitised("by Zorblax of 4711 here", [(3, 4, 10), (14, 4, 18), (19, 5, 23)]) == "by [name] of 4xxx "
