"""Licence scans.

One Aho-Corasick automaton over a text's words finds notice phrases and identifier tags. The expression after a tag
is turned into postfix order by a shunting yard (WITH binds closest, then AND, then OR) and evaluated: its licences,
and whether it leaves a permissive choice. Where more than the expression follows on its line, the longest expression
at the line's start counts, of operators in capitals and of words that look like identifiers.

A null text counts as empty: no words, no labels, score 0. Rows are independent: repeated rows give equal rows, other
columns are not looked at, an empty table gives an empty one. Whole texts are searched, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices that the method adds, as words.
NOTICES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "gnu general public license as published by": "gpl",
    "gplv2": "gpl-2",
    "gplv3": "gpl-3",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "boost software license": "boost",
    "artistic license": "artistic",
    "sil open font license": "ofl",
    "european union public licence": "eupl",
    "this is free and unencumbered software": "public-domain",
    "cc0 1 0 universal": "cc0",
    "cc by 4 0": "cc-by",
    "open database license": "odbl",
}
TAG = "spdx license identifier"
TAGGED = re.compile(r"spdx-license-identifier:[ \t]*([^\n]*)", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: What an identifier looks like where other words may follow.
IDENTIFIER = re.compile(r"[A-Z0-9.+-]+|.*[-0-9].*|[Zz]lib|[Uu]nlicense", re.ASCII)
PERMISSIVE = re.compile(r"(mit|apache|bsd|isc|zlib|0bsd|unlicense|cc0|cc-by-\d|public-domain)", re.ASCII)
BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """Shunting yard. Ids in lower case; None unless the whole of it is one well-formed expression."""
    out: list[str] = []
    wait: list[str] = []
    operand = True
    for token in TOKEN.findall(expression):
        t = token.lower()
        if t == "(":
            if not operand:
                return None
            wait.append(t)
        elif t == ")":
            while wait and wait[-1] != "(":
                out.append(wait.pop())
            if operand or not wait:
                return None
            wait.pop()
        elif t in BINDS:
            if operand:
                return None
            while wait and wait[-1] != "(" and BINDS[wait[-1]] >= BINDS[t]:
                out.append(wait.pop())
            wait.append(t)
            operand = True
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in wait:
        return None
    return out + wait[::-1]


def leading(line: str) -> list[str] | None:
    """The longest expression that a line starts with, in postfix order."""
    tokens: list[str] = []
    at = end = depth = 0
    operand = True
    for m in TOKEN.finditer(line):
        t = m[0].rstrip(".:")
        if line[at : m.start()].strip():
            break
        if t == "(" or t == ")":
            if operand != (t == "(") or t == ")" and not depth:
                break
            depth += 1 if t == "(" else -1
        elif t in ("AND", "OR", "WITH"):
            if operand:
                break
            operand = True
        elif operand and IDENTIFIER.fullmatch(t):
            operand = False
        else:
            break
        tokens.append(t)
        at = m.end()
        if not operand and not depth:
            end = len(tokens)
        if t != m[0]:  # a full stop
            break
    return postfix(" ".join(tokens[:end]))


def evaluated(order: list[str]) -> tuple[set[str], bool] | None:
    """The licences of an expression, and whether one may choose permissive terms only."""
    stack: list[tuple[set[str], bool]] = []
    for t in order:
        if t in BINDS:
            (b, free_b), (a, free_a) = stack.pop(), stack.pop()
            if t == "with":
                if len(a) != 1 or len(b) != 1 or any("-with-" in x for x in b):
                    return None
                stack.append(({f"{next(iter(a))}-with-{next(iter(b))}"}, free_a))
            else:
                stack.append((a | b, free_a or free_b if t == "or" else free_a and free_b))
        else:
            stack.append(({t}, bool(PERMISSIVE.match(t))))
    return stack[0]


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scanned(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive."""
    words = WORD.findall(text.lower() if text.isascii() else text.encode("utf-8").lower().decode("utf-8"))  # A-Z only
    line = f" {' '.join(words)} "
    starts, base, more, tagged = [], set(), set(), False
    for end, phrase in automaton().iter(line):
        if phrase in BASE:
            starts.append(end - len(phrase) - 1)
            base.add(BASE[phrase])
        elif phrase == TAG:
            tagged = True
        else:
            more.add(NOTICES[phrase])
    first = last = None
    if starts:
        first, last = line.count(" ", 0, min(starts)), line.count(" ", 0, max(starts))
    free, said = [PERMISSIVE.match(x) is not None for x in base | more], []
    if tagged:
        for m in TAGGED.finditer(text):
            order = postfix(m[1]) or leading(m[1])
            if order and (found := evaluated(order)):
                more |= {x.replace(",", " ") for x in found[0]}
                free.append(found[1])
                said.append(" ".join(order))
    score = 1.0 if base or said else 0.8 if more else 0.0
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), score, said, all(free) if free else None


SCHEMA = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("permissive", pa.bool_())]


def scan_licences(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each row: key, word count, base places and labels, all labels, score, expressions in postfix order, and whether every notice leaves a permissive choice."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in slices(batches):
            rows = [scanned(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(SCHEMA)]], names=["key", *[n for n, _ in SCHEMA]])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(scan, "key long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean").withColumnRenamed("key", key)
