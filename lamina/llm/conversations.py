"""Repair of the structure of conversations, at least cost, by a rank-convergence parallel Viterbi.

Turns must have the roles (s?(ua)+)?, by initials. Edits walk an automaton with the states nothing, s, u and a: Keep a
turn, Rerole it, Delete it, or Insert an empty one; the state tells which role is next, so the edits alone tell the
result. A vector of the costs from each state to the end is carried backwards over the turns.

Turns are dealt to parts by ranges of (conversation, turn, role, hash of the text, number of the row), so that a long
conversation lies in many parts, in order. A conversation within one part is repaired as it streams by. Of others, each
part has a chunk (its turns, bounded by the part). Chunks start from a speculative vector, that of a conversation's end.
Fix-up passes run a chunk again from the vector that the next one has found, until it differs from that of the pass
before only by a constant; then all earlier turns have the right costs but for constants, which change no choice. Each
chunk is traced from all four states with the right vector behind it, states are passed on from chunk to chunk, and what
was traced from the state that comes is the repair. The repaired text of a chunk is a file in the shared folder; the
digest of a conversation is taken from its files in turn, since a digest is sequential, a piece at a time.

Nulls: a null id, turn, role or text counts as one space, also where faults are drawn; null ids are one conversation,
and null turns come first. Turns of one number go by role, then by hash of the text; repeated rows stay together, and
all but the first of them are duplicates. A role's initial is its first character; an empty one has none. gaps is the
largest long where it is larger. An empty table gives no rows; other columns are not looked at. Texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import opened, shared_dir, store_file, written

#: Bytes of text in a part, on average.
PART_BYTES = 16 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a. From each: the state that an inserted or reroled turn leads to, and by role initials that may be kept.
START, ENDS = 0, (0, 3)
NEXT = (2, 2, 3, 2)
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
FAULTS = ("blank", "duplicate", "truncated")
BLANK = " \t\n\x0b\x0c\r"
Vector = tuple[int, int, int, int]
REPAIR = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURN = "struct<role: string, text: string, fault: string, digest: binary>"


def closed(costs: list[int]) -> Vector:
    """Costs of states where turns may be inserted first."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


#: From each state at the end of a conversation.
END = closed([0 if s in ENDS else 1 << 20 for s in range(4)])


def edits(initial: str, fault: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of each edit that a turn allows."""
    yield "D", DELETE, state
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED * (fault == "truncated")
        if initial in KEPT[state]:
            yield "K", KEEP + more, KEPT[state][initial]
        yield "R", REROLE + more, NEXT[state]


@lru_cache(maxsize=65_536)
def before(initial: str, fault: str, after: Vector) -> Vector:
    """The vector before a turn, from that after it."""
    return closed([min(cost + after[to] for _, cost, to in edits(initial, fault, s)) for s in range(4)])


def shape(vector: Vector) -> Vector:
    """Equal for vectors that differ by a constant."""
    return tuple(c - min(vector) for c in vector)


def backward(turns: list[tuple[str, str]], after: Vector) -> list[Vector]:
    """The vectors before each turn (initial, fault) and after the last, but for constants."""
    out = [shape(after)]
    for initial, fault in reversed(turns):
        out.append(shape(before(initial, fault, out[-1])))
    return out[::-1]


@lru_cache(maxsize=65_536)
def step(initial: str, fault: str, state: int, after: Vector) -> tuple[str, int, int]:
    """The least letters that lead past a turn at least cost, their cost and the next state."""
    costs = before(initial, fault, after)
    letters, spent = "", 0
    while True:
        choices = [(e, c, to) for e, c, to in edits(initial, fault, state) if c + after[to] == costs[state]]
        if INSERT + costs[NEXT[state]] == costs[state]:
            choices.append(("I", INSERT, NEXT[state]))
        letter, cost, state = min(choices)
        letters, spent = letters + letter, spent + cost
        if letter != "I":
            return letters, spent, state


def traced(turns: list[tuple[str, str]], vectors: list[Vector], state: int) -> tuple[list[str], int, int]:
    """Letters for each turn, their cost and the state after the last."""
    out, spent = [], 0
    for (initial, fault), after in zip(turns, vectors[1:], strict=True):
        letters, cost, state = step(initial, fault, state, after)
        out.append(letters)
        spent += cost
    return out, spent, state


def ending(state: int) -> str:
    """Inserts that end a conversation."""
    letters = ""
    while state not in ENDS:
        letters, state = letters + "I", NEXT[state]
    return letters


def repaired(turns: list[dict], letters: list[str], state: int) -> Iterator[str]:
    """role:text of each turn that the edits leave; turns: role and text of each."""
    for turn, some in zip(turns, letters, strict=True):
        for letter in some:
            if letter == "D":
                continue
            if letter == "K":
                state = KEPT[state][turn["role"][0]]
                yield f"{turn['role']}:{turn['text']}"
            else:
                state = NEXT[state]
                yield f"{ROLE[state]}:{turn['text'] if letter == 'R' else ''}"


class Turns:
    """A conversation's turns within one part, as they come."""

    def __init__(self, conversation: int | None):
        self.conversation = conversation
        self.turns: list[dict] = []
        self.numbers: list[int] = []  # distinct ones, ascending
        self.seen: set[bytes] = set()

    def add(self, number: int | None, role: str, text: str) -> None:
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        bare = text.rstrip(BLANK)
        fault = "blank" if not bare else "duplicate" if digest in self.seen else "" if bare[-1] in ".!?" else "truncated"
        self.seen.add(digest)
        if number is not None and (not self.numbers or self.numbers[-1] != number):
            self.numbers.append(number)
        self.turns.append({"role": role, "text": text, "fault": fault, "digest": digest})

    def facts(self) -> dict:
        """What the part knows about the conversation."""
        initials = [t["role"][:1] for t in self.turns]
        return {
            "conv_id": self.conversation, "n": len(initials), "low": self.numbers[0] if self.numbers else None, "high": self.numbers[-1] if self.numbers else None, "numbers": len(self.numbers),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
        }


FACTS = "conv_id long, n long, low long, high long, numbers long, illegal long, first string, last string"
CHUNK = f"part int, {FACTS}, turns array<{TURN}>"


def codes(turns: list[dict]) -> list[tuple[str, str]]:
    return [(t["role"][:1], t["fault"]) for t in turns]


def counted(turns: list[dict], fault: str) -> int:
    return sum(t["fault"] == fault for t in turns)


def gaps(facts: list[dict]) -> int:
    """Numbers that are missing between the least and the largest; chunks in turn, which may share numbers at their edges."""
    with_numbers = [f for f in facts if f["numbers"]]
    if not with_numbers:
        return 0
    distinct = sum(f["numbers"] for f in with_numbers) - sum(a["high"] == b["low"] for a, b in zip(with_numbers, with_numbers[1:], strict=False))
    return min(with_numbers[-1]["high"] - with_numbers[0]["low"] + 1 - distinct, (1 << 63) - 1)


def finished(own: Turns) -> dict:
    """The row of a conversation that lies within one part."""
    facts, turns = own.facts(), codes(own.turns)
    letters, cost, state = traced(turns, backward(turns, END), START)
    rest = ending(state)
    lines = [*repaired(own.turns, letters, START), *(f"{ROLE[s]}:" for s in inserted(state))]
    return {
        "conv_id": own.conversation, "gaps": gaps([facts]), **{k: counted(own.turns, k) for k in FAULTS}, "illegal": facts["illegal"],
        "cost": cost + INSERT * len(rest), "audit": "".join(letters) + rest, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def repair_kind() -> pa.Schema:
    return pa.schema([(k, pa.string() if t == "string" else pa.int64()) for k, t in (c.split() for c in REPAIR.split(", "))])


def chunk_kind() -> pa.DataType:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    turn = pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("digest", pa.binary())])
    return pa.struct([("part", pa.int32()), *((k, kinds[t]) for k, t in (c.split() for c in FACTS.split(", "))), ("turns", pa.list_(turn))])


def inserted(state: int) -> Iterator[int]:
    """States after each insert that ends a conversation."""
    while state not in ENDS:
        state = NEXT[state]
        yield state


def revised(turns: list[tuple[str, str]], before_: Vector, now: Vector, start: Vector) -> Vector:
    """The shape of the vector before all turns with the vector now after them, when start is that with another one. Ends where both differ by a constant."""
    old, new = shape(before_), shape(now)
    for initial, fault in reversed(turns):
        if old == new:
            return start
        old, new = (shape(before(initial, fault, x)) for x in (old, new))
    return new


VECTORS = "name string, nth int, of int, after array<int>, start array<int>"


def stitched(turns: DataFrame) -> DataFrame:
    """Rows of VECTORS: the vectors after and before each chunk, but for constants. turns: name, nth, of (the number of chunks) and code, (initial, fault) of each turn."""

    def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
        for row in batch.to_pylist():
            yield row | {"code": [(c["initial"], c["fault"]) for c in row["code"]]}

    def speculated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{"name": r["name"], "nth": r["nth"], "of": r["of"], "after": END, "start": backward(r["code"], END)[0]} for r in rows_of(batch)]
            yield pa.RecordBatch.from_pylist(found, vector_kind())

    def fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{"name": r["name"], "nth": r["nth"], "of": r["of"], "after": r["coming"], "start": revised(r["code"], tuple(r["after"]), tuple(r["coming"]), tuple(r["start"]))} for r in rows_of(batch)]
            yield pa.RecordBatch.from_pylist(found, vector_kind())

    vectors = written(turns.mapInArrow(speculated, VECTORS))
    while True:
        coming = vectors.select("name", (F.col("nth") - 1).alias("nth"), F.col("start").alias("coming"))
        met = written(vectors.join(coming, ["name", "nth"], "left"))
        rerun = F.coalesce(F.col("coming") != F.col("after"), F.lit(False))
        if not met.where(rerun).limit(1).count():
            return vectors
        again = turns.select("name", "nth", "code").join(met.where(rerun), ["name", "nth"]).mapInArrow(fixed, VECTORS)
        vectors = written(met.where(~rerun).drop("coming").unionByName(again))


def vector_kind() -> pa.Schema:
    costs = pa.list_(pa.int32())
    return pa.schema([("name", pa.string()), ("nth", pa.int32()), ("of", pa.int32()), ("after", costs), ("start", costs)])


def joined(chunks: DataFrame, folder: str) -> DataFrame:
    """Rows of REPAIR from the chunks of conversations that may lie in several parts. What meets by conversation is a small row for each of its chunks, but for the audit, which is part of the result."""
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    chunks = chunks.withColumn("name", name)
    nth = F.row_number().over(Window.partitionBy("name").orderBy("part"))
    places = written(chunks.select("name", "part").withColumns({"nth": nth, "of": F.count("*").over(Window.partitionBy("name")).cast("int")}))
    placed = chunks.join(places, ["name", "part"])
    digest = placed.where("of > 1").select("name", "nth", F.explode(F.array_distinct("turns.digest")).alias("digest"))
    first = digest.groupBy("name", "digest").agg(F.min("nth").alias("first"))
    known = digest.join(first, ["name", "digest"]).where("nth > first").groupBy("name", "nth").agg(F.collect_list("digest").alias("known"))
    fault = lambda t: F.when((t["fault"] != "blank") & F.coalesce(F.array_contains("known", t["digest"]), F.lit(False)), "duplicate").otherwise(t["fault"])
    turns = placed.join(known, ["name", "nth"], "left").withColumn("turns", F.transform("turns", lambda t: t.withField("fault", fault(t)))).drop("known")
    turns = written(turns, f"{folder}/chunks")
    code = F.transform("turns", lambda t: F.struct(F.left(t["role"], F.lit(1)).alias("initial"), t["fault"].alias("fault")))
    light = turns.select("name", "nth", "of", code.alias("code"))
    after = stitched(light).select("name", "nth", "after")

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state after each chunk, from each state before it."""
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                own = [(c["initial"], c["fault"]) for c in row["code"]]
                vectors = backward(own, tuple(row["after"]))
                found.append({"name": row["name"], "nth": row["nth"], "exits": [traced(own, vectors, s)[2] for s in range(4)]})
            yield pa.RecordBatch.from_pylist(found, pa.schema([("name", pa.string()), ("nth", pa.int32()), ("exits", pa.list_(pa.int32()))]))

    left = light.join(after, ["name", "nth"]).mapInArrow(exits, "name string, nth int, exits array<int>")
    many = [F.size(F.array_remove(F.transform("turns.fault", lambda f: f == k), F.lit(False))).alias(k) for k in FAULTS]  # noqa: B023  called at once
    facts = turns.select("name", "nth", "conv_id", *[c.split()[0] for c in FACTS.split(", ")[1:]], *many)
    member = left.join(facts, ["name", "nth"])
    chains = member.groupBy("name").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct(*[c for c in member.columns if c not in ("name", "conv_id")]))).alias("chain"))
    linked = written(chains.mapInArrow(linked_chains, LINKED))
    entries = linked.select("name", F.posexplode("entries").alias("at", "entry")).select("name", (F.col("at") + 1).alias("nth"), "entry")

    def repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Letters and cost of each chunk; its repaired text goes to a file."""
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                own = codes(row["turns"])
                letters, cost, _ = traced(own, backward(own, tuple(row["after"])), row["entry"])
                uri = f"{folder}/text/{row['part']}-{'null' if row['conv_id'] is None else row['conv_id']}"
                lines = repaired(row["turns"], letters, row["entry"])
                first = next(lines, None)
                store_file(uri, [] if first is None else [first.encode(), *(f"\n{x}".encode() for x in lines)])
                found.append({"name": row["name"], "nth": row["nth"], "letters": "".join(letters), "cost": cost, "uri": None if first is None else uri})
            yield pa.RecordBatch.from_pylist(found, pa.schema([("name", pa.string()), ("nth", pa.int32()), ("letters", pa.string()), ("cost", pa.int64()), ("uri", pa.string())]))

    done = turns.select("name", "nth", "part", "conv_id", "turns").join(after, ["name", "nth"]).join(entries, ["name", "nth"])
    pieces = written(done.mapInArrow(repairs, "name string, nth int, letters string, cost long, uri string"))
    whole = pieces.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("nth", "letters", "cost", "uri"))).alias("pieces"))

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                digest, empty = hashlib.sha256(), True
                for uri in (x["uri"] for x in row["pieces"] if x["uri"] is not None):
                    digest.update(b"" if empty else b"\n")
                    empty = False
                    with opened(uri) as f:
                        while piece := f.read(1 << 20):
                            digest.update(piece)
                rest = ending(row["state"])
                for state in inserted(row["state"]):
                    digest.update((("" if empty else "\n") + f"{ROLE[state]}:").encode())
                    empty = False
                found.append({k: row[k] for k in ("conv_id", "gaps", *FAULTS, "illegal")} | {"cost": sum(x["cost"] for x in row["pieces"]) + INSERT * len(rest), "audit": "".join(x["letters"] for x in row["pieces"]) + rest, "repaired_sha256": digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(found, repair_kind())

    return linked.drop("entries").join(whole, "name").mapInArrow(ended, REPAIR)


LINKED = "name string, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, state int, entries array<int>"


def linked_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of LINKED: what chunks in turn make of a conversation, the state before each and that after the last."""
    longs = {k: pa.int64() for k in ("conv_id", "gaps", *FAULTS, "illegal")}
    kind = pa.schema([("name", pa.string()), *longs.items(), ("state", pa.int32()), ("entries", pa.list_(pa.int32()))])
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            chain, state, entries = row["chain"], START, []
            for x in chain:
                entries.append(state)
                state = x["exits"][state]
            held = [x for x in chain if x["n"]]
            between = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(held, held[1:], strict=False))
            found.append({"name": row["name"], "conv_id": row["conv_id"], "gaps": gaps(chain), **{k: sum(x[k] for x in chain) for k in FAULTS}, "illegal": between + sum(x["illegal"] for x in chain), "state": state, "entries": entries})
        yield pa.RecordBatch.from_pylist(found, kind)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone of rows with faults drawn from conversation and turn. Dropped rows stay, as gone ones, so that no conversation is lost."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), said("role").alias("role"), said("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def repaired_conversations(rows: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows of REPAIR, one for each conversation. rows: conv_id, turn, role, text and perhaps gone (a row that only tells that the conversation is there)."""
    spark = rows.sparkSession
    folder = shared_dir(spark)
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    said = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), said("role").alias("role"), said("text").alias("text"), gone.alias("gone"))
    total = rows.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    order = ["conv_id", "turn", "role", "hash", "row"]  # nulls come first
    keyed = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(total // part_bytes + 1, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finished conversations, and the chunks of the first and the last one of the part, which may go on in others."""
        part, own, first, done = TaskContext.get().partitionId(), None, True, []

        def batch(rows: list[dict], chunks: list[dict]) -> pa.RecordBatch:
            columns = [pa.array([*rows, *[None] * len(chunks)], pa.struct(repair_kind())), pa.array([*[None] * len(rows), *chunks], chunk_kind())]
            return pa.RecordBatch.from_arrays(columns, names=["row", "chunk"])

        for held in batches:
            for conversation, number, role, text, dropped in zip(*(c.to_pylist() for c in held.columns), strict=True):
                if own is None or own.conversation != conversation:
                    if own is not None:
                        if first:
                            yield batch([], [{"part": part, **own.facts(), "turns": own.turns}])
                        else:
                            done.append(finished(own))
                        first = False
                    own = Turns(conversation)
                if not dropped:
                    own.add(number, role, text)
            if done:
                yield batch(done, [])
                done = []
        if own is not None:
            yield batch([], [{"part": part, **own.facts(), "turns": own.turns}])

    both = written(dealt.mapInArrow(streamed, f"row struct<{REPAIR}>, chunk struct<{CHUNK}>"), f"{folder}/parts")
    whole = both.where("row is not null").select("row.*")
    chunks = both.where("chunk is not null").select("chunk.*")
    return whole.unionByName(joined(chunks, folder))
