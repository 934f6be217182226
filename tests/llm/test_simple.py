import hashlib
import re
import zlib

import numpy as np

from lamina.llm import language, licences, media, queries


def test_licence_words_and_places(spark, docs, texts):
    said = "Released UNDER the MIT License. under the mit license under the mit license; CC BY-NC 4.0, Apache License, Version 2.0"
    docs = docs.unionByName(spark.createDataFrame([(50, said, "s", "k"), (51, "x\nSPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception\n", "s", "k"), (52, "SPDX-License-Identifier: mit or", "s", "k")], docs.schema))
    found = {r["doc_id"]: r for r in licences.scan_licences(docs).collect()}
    r = found[50]
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", said.lower())
    starts = [i for i in range(len(words)) for p in licences.BASE if words[i : i + len(p.split())] == p.split()]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(starts), min(starts), max(starts), "apache-2,cc-by-nc,mit")
    assert found[51]["labels"] == "apache-2.0-with-llvm-exception,gpl-2.0-only,mit" and found[51]["permissive"] and found[51]["n_base"] == 0
    assert found[52]["labels"] == "" and found[0]["n_words"] == 0 and found[0]["first_word"] is None
    assert len(found) == docs.count() and licences.scan_licences(docs.where("false")).count() == 0


def test_shunting_yard():
    assert licences.postfix("a or b and c") == ["a", "b", "c", "and", "or"]
    assert licences.postfix("(a or b) and c with d") == ["a", "b", "or", "c", "d", "with", "and"]
    for wrong in ("", "a b", "a or", "(a", "a)", "()", "with a"):
        assert licences.postfix(wrong) is None


def test_expressions_with_words_after_them():
    cases = {"MIT. Copyright 2020": ["mit"], "Apache-2.0 This file is": ["apache-2.0"], "(MIT OR GPL-2.0+) AND ISC -- see": ["mit", "gpl-2.0+", "or", "isc", "and"], "MIT AND (x": ["mit"], "MIT OR": ["mit"], "GPL-2.0-only WITH Classpath-exception-2.0. More": ["gpl-2.0-only", "classpath-exception-2.0", "with"], "This file": None, "": None, "(MIT": None, "MIT and other words": ["mit"]}
    for line, order in cases.items():
        assert licences.leading(line) == order
    text = "x SPDX-License-Identifier: MIT. Copyright 2020 by all. GNU General Public License as published by the"
    assert licences.scanned(text)[5] == "gpl,mit"
    assert licences.scanned("SPDX-License-Identifier: " + "(" * 200_000)[5] == ""


def test_profile_equals_bundling_by_hand():
    s = language.Space(256)
    text = "Ab, ça ab"
    got = s.documents([text, "", "12"])
    grams = [" ab", "ab ", "b ç", " ça", "ça ", "a a", " ab", "ab "]
    hand = np.zeros(256)
    for g in grams:
        v = np.ones(256)
        for place, c in enumerate(g):
            v *= np.roll(s.of_letter(0 if c == " " else ord(c)).astype(float), place)
        hand += v
    assert (got[0] == hand).all() and not got[1:].any()


def test_language(spark):
    words = {"en": "the and of with that", "de": "und der nicht für sich", "fr": "avec être les dans où"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(w.split() * 3)), lang, "x") for k, (lang, w) in enumerate(words.items()) for i in range(k * 10, k * 10 + 10)]
    docs = spark.createDataFrame([*rows, (90, None, "en", "x"), (91, "", "de", "x"), (92, "1 2 3", None, "x"), (None, "the and of", None, "x")], "doc_id long, text string, lang string, score string")
    model = language.Profiles.fit(docs)
    found = {r["doc_id"]: r for r in model.predict(docs).collect()}
    assert all(found[i]["lang_pred"] == lang and 0 <= found[i]["score"] <= 1 for i, _, lang, _ in rows)
    assert [found[i]["lang_pred"] for i in (90, 91, 92, None)] == ["und", "und", "und", "en"]
    empty = language.Profiles.fit(docs.where("false"))
    assert {r["lang_pred"] for r in empty.predict(docs).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.op3_language_id(spark, sf).where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_media_round_trip(spark, docs, texts, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in queries.op10_media_columns(spark, str(tmp_path)).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = found[i if i != 4 else None]
        stored = media.encoded(payload)
        assert media.decoded(stored) == payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_interleaving_keeps_order_and_captions(spark):
    page = '<html><head><style>p{}</style><script>var t="</p>";</script></head><body><p>One <b>bold</b> &amp; two</p><figure><img src="sha256:D" alt="alt"><figcaption>Cap <i>tion</i></figcaption></figure><p>Three<br>four</p><img src="http://x/y.png" alt="other"></body></html>'
    digest = hashlib.sha256(media.padded(b"pixels")).hexdigest()
    pages = spark.createDataFrame([(1, page.replace("D", digest)), (2, None), (3, "")], "page_id long, html string")
    stored = media.read_media(media.media_table(spark.createDataFrame([(7, "pixels"), (8, "pixels")], "k long, p string"), "k", "p"))
    rows = {r["page_id"]: r["parts"] for r in media.interleave(media.parse_pages(pages, "html", "page_id"), stored).collect()}
    assert rows[2] == rows[3] == []
    parts = rows[1]
    assert [(p["kind"], p["text"], p["caption"]) for p in parts] == [("text", "One bold & two", None), ("media", None, "Cap tion"), ("text", "Three", None), ("text", "four", None), ("media", None, "other")]
    assert [p["position"] for p in parts] == [0, 1, 2, 3, 4] and parts[1]["media"]["payload_sha256"] == digest and parts[4]["media"] is None


def test_pages_of_one_key_and_no_pages(spark):
    a, b = (hashlib.sha256(media.padded(x)).hexdigest() for x in (b"a", b"b"))
    html = [f'<p>x</p><img src="sha256:{a}"><img src="sha256:{b}"><img src="sha256:{a}">', f'<img src="sha256:{b}">', '<img src="sha256:none">', None]
    pages = spark.createDataFrame([(k, h, "own") for h in html for k in (None, 1, 1)], "id long, page string, parts_ string").withColumnRenamed("parts_", "media")
    stored = media.read_media(media.media_table(spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, p string"), "k", "p"))
    rows = media.interleave(media.parse_pages(pages, "page", "id", "media"), stored).collect()
    assert len(rows) == 12 and all(r["media"] == "own" for r in rows)
    shown = sorted(str([(p["kind"], p["media"] and p["media"]["payload_sha256"]) for p in r["parts"]]) for r in rows)
    hand = [[("text", None), ("media", a), ("media", b), ("media", a)], [("media", b)], [("media", None)], []]
    assert shown == sorted(str(h) for h in hand for _ in range(3))
    assert media.interleave(media.parse_pages(pages.where("false"), "page", "id"), stored).count() == 0
    assert media.read_media(media.media_table(pages.where("false"), "id", "page")).count() == 0


def test_pages_that_are_not_well_formed():
    short = lambda html: [(p[0], p[1], p[3]) for p in media.parsed(html)]
    assert short("<figure><figcaption>Before</figcaption><img src=x></figure>after") == [("media", None, "Before"), ("text", "after", None)]
    assert short("<figure><img src=x><img src=y><figcaption>Two <p>lines</p></figure>after") == [("media", None, "Two lines"), ("media", None, "Two lines"), ("text", "after", None)]
    assert short("<figure><img src=x alt=a><figcaption>Never <p>ends") == [("media", None, "a"), ("text", "Never ends", None)]
    assert short("<figcaption>No figure</figcaption> more") == [("text", "No figure", None), ("text", "more", None)]
    assert short("a<noscript>b<img src=x> c") == [("text", "ab", None), ("media", None, None), ("text", "c", None)]
    assert short("a<template>hidden<img src=x></template>b") == [("text", "a", None), ("text", "b", None)]
    assert short("a<template>open<p>b") == [("text", "a", None), ("text", "open", None), ("text", "b", None)]
    assert short("<figure><figcaption>Of nothing</figcaption></figure>") == [("text", "Of nothing", None)]
    assert short("") == [] and len(short("x <b>y</b> " * 100_000)) == 1


def test_feature_by_hand():
    for data in (b"", b"abc", bytes(range(256)) * 5000, b"\xff" * 64):
        payload = media.padded(data)
        n, mean = len(payload), sum(payload) / len(payload)
        sd = (sum((x - mean) ** 2 for x in payload) / n) ** 0.5
        size, got_mean, got_sd, hist = media.feature(payload).split(";")
        assert size == f"64x{n // 64}" and got_mean == f"mean={mean:.3f}" and abs(float(got_sd[3:]) - sd) < 2e-3
        assert hist == "hist=" + "-".join(str(sum(x >> 5 == k for x in payload) * 1000 // n) for k in range(8))
