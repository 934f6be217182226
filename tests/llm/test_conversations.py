import hashlib
import random
import re
import zlib

import pytest

from lamina.llm import conversations as C

FORM = re.compile("(s?(ua)+)?")


def damage(rows):
    """(conversation, turn, role, text) after damage, and all conversations."""
    out = []
    said = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        role, text = said(role), said(text)
        fault = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(turns):
    """All edits of turns (role, text, fault) within a rising bound of cost: the least (cost, audit) and what it leaves. No state is kept but the roles so far."""

    def tried(i, roles, cost, audit, lines, bound):
        if cost > bound or not any(FORM.fullmatch(roles + x) for x in ("", "a", "ua")):
            return
        if i == len(turns) and FORM.fullmatch(roles):
            yield cost, audit, lines
        for role in ("user", "assistant"):
            yield from tried(i, roles + role[0], cost + 2, audit + "I", [*lines, f"{role}:"], bound)
        if i < len(turns):
            role, text, fault = turns[i]
            yield from tried(i + 1, roles, cost + 3, audit + "D", lines, bound)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                yield from tried(i + 1, roles + role[:1], cost + more, audit + "K", [*lines, f"{role}:{text}"], bound) if role else ()
                for other in ("user", "assistant"):
                    yield from tried(i + 1, roles + other[0], cost + 2 + more, audit + "R", [*lines, f"{other}:{text}"], bound)

    return next(min(found) for bound in range(99) if (found := list(tried(0, "", 0, "", [], bound))))


def by_hand(rows):
    found, left = {}, damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        seen, turns = set(), []
        for _, _, role, text in own:
            bare = text.strip(C.BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = [r[1] for r in own if r[1] is not None]
        cost, audit, lines = cheapest(turns)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        found[conv] = (gaps, *(sum(t[2] == f for t in turns) for f in C.FAULTS), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def made(seed, conversations=25, turns=5):
    r = random.Random(seed)
    rows = []
    for c in range(conversations):
        numbers = r.sample(range(12), r.randint(1, turns))
        rows += [(c, t, r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), r.choice(["Yes.", "No", "Oh? \n", "", " \t", None, "Why not!", "Ünd é…", "x" * 50 + "."])) for t in numbers]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Hm."), (conversations, None, None, None)]
    r.shuffle(rows)
    return rows


KIND = "conv_id long, turn long, role string, text string"


def answer(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize(("seed", "part_bytes"), [(1, 1 << 20), (2, 120)])
def test_repair_equals_brute_force(spark, seed, part_bytes):
    rows = made(seed)
    df = spark.createDataFrame(rows, KIND).repartition(3)
    assert answer(C.repaired_conversations(C.damaged(df), part_bytes)) == by_hand(rows)


def test_a_long_conversation_in_many_parts_equals_one_in_one(spark):
    r = random.Random(5)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice([f"{t % 90} so.", f"{t} no", "", "Same."])) for t in range(1500)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for c in (6, 8) for t in range(4)]
    df = C.damaged(spark.createDataFrame(rows, KIND))
    one, many = answer(C.repaired_conversations(df)), answer(C.repaired_conversations(df, 2500))
    assert one == many and len(one[7][6]) > 1000
    own = C.Turns(7)
    for conv, turn, role, text in damage(rows):
        if conv == 7:
            own.add(turn, role, text)
    expected = C.finished(own)
    assert one[7] == tuple(expected.values())[1:]


def test_chunks_are_corrected_until_they_differ_by_constants():
    r = random.Random(3)
    changed = 0
    for _ in range(300):
        turns = [(r.choice("suax"), r.choice(["", "", "truncated", "duplicate"])) for _ in range(r.randint(1, 12))]
        other = C.backward([(r.choice("suax"), r.choice(["", "truncated"])) for _ in range(r.randint(1, 4))], C.END)[0]
        guess = C.backward(turns, C.END)[0]
        right = C.backward(turns, other)[0]
        assert C.revised(turns, C.END, other, guess) == right
        changed += guess != right
    assert changed  # some guesses were wrong


def test_repeated_rows_no_rows_and_odd_columns(spark):
    df = spark.createDataFrame([(1, 2, "user", "Hi.")] * 40 + [(1, 3, "assistant", "Yes.")], KIND)
    found = answer(C.repaired_conversations(df.selectExpr("*", "'x' as name", "1 as hash", "map('a', 1) as part"), 60))
    assert found[1] == (0, 0, 39, 0, 39, 117, "K" + "D" * 39 + "K", hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest())
    assert C.repaired_conversations(C.damaged(df.where("false"))).count() == 0
    gone = C.repaired_conversations(df.selectExpr("*", "true as gone")).collect()
    assert [tuple(r) for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_huge_numbers_and_long_texts(spark):
    rows = [(1, -(1 << 63), "user", "a " * 200_000 + "."), (1, (1 << 63) - 1, "assistant", "b" * 300_000 + "?")]
    found = answer(C.repaired_conversations(spark.createDataFrame(rows, KIND)))
    assert found[1][0] == (1 << 63) - 1 and found[1][6] == "KK"
