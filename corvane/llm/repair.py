"""Repair the structure of conversations by the cheapest edits.

A repaired conversation has a system message or none, then pairs of a user's
and an assistant's message. Edits: keep a row (K, free), give it the role user
or assistant (R, 1), delete it (D, 2; a must for blank and duplicate rows),
insert an empty message (I, 5). A truncated row that is not deleted costs 5.
Where several edit scripts are cheapest, the least one in ASCII order is taken.

The costs from each row to the end, one per state of the role automaton, come
from a backward pass. It stores them at every square root of n rows only; the
forward walk works each block out again from the checkpoint at its end and takes,
row by row, the least letter on a cheapest path. A letter names its target
state, so that walk is the least script.

All rows of a conversation go in order through one task, since the digest over
the repaired conversation has no other way; they stream through it. Of a
conversation a task holds one byte per row and the script. Which rows repeat an
earlier one is known before: the first turn of every role and text comes from a
combined aggregate, as a record of its own that is sorted in before its row.

Defined results. NULL role or text is one space, so such a text is blank. Rows are
in order of turn, NULL first, then of role and text digest; equal rows are
neighbours. A role counts by its first character; a row with an empty role may
be kept and adds nothing. NULL is a conversation of its own. A conversation
without rows has zeros, an empty script and the digest of the empty text. An
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"

# States: nothing yet, after the system, after a user, after an assistant.
NEXT = (2, 2, 3, 2)  # where a user's or an assistant's message leads
ROLE = ("", "", "user", "assistant")  # whose message led to a state
END = (0, INSERT * 2, INSERT, 0)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "": (0, 1, 2, 3)}
INITIALS = ("s", "u", "a", "", "?")
FORCED = 2 * len(INITIALS)  # the code of a row that must go

Costs = tuple[int, ...]


def code_of(role: str, must_go: bool, truncated: bool) -> int:
    """A row as the one byte that its edits depend on."""
    initial = role[:1] if role[:1] in KEPT else "?"
    return FORCED if must_go else 2 * INITIALS.index(initial) + truncated


def _edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """``letter, cost, next state`` of a row, in ASCII order."""
    edits = [("D", DELETE, state)]
    if code != FORCED:
        late = TRUNCATED * (code % 2)
        kept = KEPT.get(INITIALS[code // 2], (None,) * 4)[state]
        if kept is not None:
            edits.append(("K", late, kept))
        edits.append(("R", REROLE + late, NEXT[state]))
    return edits


EDITS = [[_edits(code, state) for state in range(4)] for code in range(FORCED + 1)]


class Backward:
    """Costs before a row from the costs behind it; few different ones occur, so each is worked out once."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, Costs], tuple[Costs, int]] = {}

    def __call__(self, code: int, costs: Costs) -> tuple[Costs, int]:
        """The costs, less the least of them, and that least."""
        found = self.known.get((code, costs))
        if found is None:
            row = [min(cost + costs[to] for _, cost, to in EDITS[code][state]) for state in range(4)]
            # A message can be inserted before the row: never more than two in a row are of use.
            user, assistant = min(row[2], INSERT + row[3]), min(row[3], INSERT + row[2])
            full = (min(row[0], INSERT + user), min(row[1], INSERT + user), user, assistant)
            least = min(full)
            found = self.known[code, costs] = tuple(c - least for c in full), least
        return found


def script(codes: bytes, back: Backward) -> tuple[int, str]:
    """Cost and letters of the ASCII-least cheapest edits."""
    rows = len(codes)
    step = isqrt(rows) + 1
    checkpoints, costs, total = {rows: END}, END, 0
    for at in range(rows - 1, -1, -1):
        costs, least = back(codes[at], costs)
        total += least
        if at % step == 0:
            checkpoints[at] = costs
    cost = total + costs[0]

    letters, state = [], 0
    for start in range(0, rows, step):
        end = min(start + step, rows)
        block = [(checkpoints[end], 0)]
        for at in range(end - 1, start - 1, -1):
            block.append(back(codes[at], block[-1][0]))
        for at in range(start, end):
            (now, base), (later, _) = block[end - at], block[end - at - 1]
            while True:
                left = now[state] + base
                if DELETE + later[state] == left:
                    letters.append("D")
                    break
                if INSERT + now[NEXT[state]] + base == left:
                    letters.append("I")
                    state = NEXT[state]
                    continue
                tight = next((e for e in EDITS[codes[at]][state][1:] if e[1] + later[e[2]] == left))
                letters.append(tight[0])
                state = tight[2]
                break
    while END[state]:
        letters.append("I")
        state = NEXT[state]
    return cost, "".join(letters)


class Repaired(NamedTuple):
    role: str
    text: str | None  # None: what the row says
    edit: str


class Walk:
    """Applies a script to the rows as they come."""

    def __init__(self, letters: str):
        self.letters, self.at, self.state = letters, 0, 0

    def _inserted(self) -> Iterator[Repaired]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.state = NEXT[self.state]
            self.at += 1
            yield Repaired(ROLE[self.state], "", "I")

    def row(self, role: str) -> Iterator[Repaired]:
        """What stands in place of the next row: messages inserted before it, and itself unless it goes."""
        yield from self._inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "R":
            self.state = NEXT[self.state]
            yield Repaired(ROLE[self.state], None, letter)
        elif letter == "K":
            self.state = KEPT[role[:1]][self.state]
            yield Repaired(role, None, letter)

    def end(self) -> Iterator[Repaired]:
        return self._inserted()


class Conversation:
    """One conversation while its records stream by."""

    def __init__(self, conv_id, back: Backward):
        self.conv_id, self.back, self.codes = conv_id, back, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = None
        self.turns, self.last_turn, self.initial, self.first = 0, None, None, False
        self.digest, self.places, self.walk = sha256(), 0, None

    def add(self, turn: int | None, role: str, blank: bool, truncated: bool) -> None:
        """A row without its text; ``first`` was set if a record before said so."""
        repeated, self.first = not self.first, False
        if blank:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        elif truncated:
            self.truncated += 1
        self.codes.append(code_of(role, blank or repeated, truncated))
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += self.most != turn
            self.most = turn

    def solve(self) -> None:
        self.cost, self.audit = script(bytes(self.codes), self.back)
        self.walk = Walk(self.audit)

    def put(self, made: Iterator[Repaired], text: str | None) -> Iterator[tuple]:
        """The repaired rows, which also go into the digest."""
        for role, own, edit in made:
            body = text if own is None else own
            self.digest.update(f"{chr(10) if self.places else ''}{role}:{body}".encode())
            yield self.conv_id, self.places, role, body, edit
            self.places += 1

    def rows(self, role: str, text: str) -> Iterator[tuple]:
        if self.walk is None:
            self.solve()
        return self.put(self.walk.row(role), text)

    def rest(self) -> Iterator[tuple]:
        if self.walk is None:
            self.solve()
        return self.put(self.walk.end(), None)

    def report(self) -> tuple:
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.turns, (1 << 63) - 1)
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost)
        return self.conv_id, *counts, self.audit, self.digest.hexdigest()


REPORT = [("conv_id", "long"), *((c, "long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))]
REPORT += [("audit", "string"), ("repaired_sha256", "string")]
ROWS = [("conv_id", "long"), ("place", "long"), ("role", "string"), ("text", "string"), ("edit", "string")]
ARROW = {"long": pa.int64(), "string": pa.string()}

# Kinds of records, in the order in which one row's come; GONE only names its conversation.
GONE, FIRST, ROW, TEXT = range(4)
OUT = 20_000  # repaired rows put out at a time
OUT_CHARS = 1 << 22


def damaged(table: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone``: conversations with faults, by a checksum of conversation and turn.

    Of twenty rows about one each is dropped (``gone``), emptied, robbed of its
    end marks, repeated, and given to the user.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    marked = table.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault"))
    body = (
        F.when(F.col("fault") == 1, "")
        .when(F.col("fault") == 2, F.translate("text", ENDS, ""))
        .otherwise(F.col("text"))
    )
    times = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return marked.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        body.alias("text"),
        (F.col("fault") == 0).alias("gone"),
        F.explode(times).alias("_time"),
    ).drop("_time")


def _records(table: DataFrame) -> DataFrame:
    """What a task reads of each conversation, to be sorted: its rows without texts, then its texts."""
    text = lambda c: F.coalesce(F.col(c), F.lit(" "))
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in table.columns else F.lit(False)
    rows = table.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        text("role").alias("role"),
        text("text").alias("text"),
        gone.alias("gone"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    # The least turn with NULL before all others: a struct's NULL field sorts first.
    first = rows.filter(~F.col("gone")).groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))

    def record(kind: int, keep: Column | None = None, blank: Column | None = None, late: Column | None = None) -> Column:
        no = F.lit(False)
        return F.struct(
            F.lit(kind).alias("kind"),
            (no if blank is None else blank).alias("blank"),
            (no if late is None else late).alias("truncated"),
            (F.lit(None).cast("string") if keep is None else keep).alias("text"),
        )

    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    light = record(ROW, None, bare == "", ~F.right(bare, F.lit(1)).isin(*ENDS))
    pair = F.when(F.col("gone"), F.array(record(GONE))).otherwise(F.array(light, record(TEXT, F.col("text"))))
    key = ["conv_id", "turn", "role", "digest"]
    own = rows.select(*key, F.explode(pair).alias("record")).select(*key, "record.*")
    known = first.select("conv_id", "first.turn", "role", "digest", record(FIRST).alias("record"))
    return own.unionByName(known.select(*key, "record.*"))


def _walked(table: DataFrame, report: bool) -> DataFrame:
    """The report of every conversation or all repaired rows, while the records stream by."""
    columns = REPORT if report else ROWS
    names, kinds = [n for n, _ in columns], [ARROW[k] for _, k in columns]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        back, talk = Backward(), None
        for batch in batches:
            for conv_id, turn, role, kind, blank, truncated, text in zip(*(c.to_pylist() for c in batch.columns)):
                if talk is None or talk.conv_id != conv_id:
                    if talk is not None:
                        rest = list(talk.rest())
                        yield from [talk.report()] if report else rest
                    talk = Conversation(conv_id, back)
                if kind == FIRST:
                    talk.first = True
                elif kind == ROW:
                    talk.add(turn, role, blank, truncated)
                elif kind == TEXT:
                    made = talk.rows(role, text)
                    if report:
                        for _ in made:
                            pass
                    else:
                        yield from made
        if talk is not None:
            rest = list(talk.rest())
            yield from [talk.report()] if report else rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in stream(batches):
            held.append(row)
            size += len(row[-2] if report else row[3])
            if len(held) >= OUT or size > OUT_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    records = _records(table).repartition("conv_id")
    texts_last = F.col("kind") == TEXT
    ordered = records.sortWithinPartitions("conv_id", texts_last, "turn", "role", "digest", "kind")
    read = ordered.select("conv_id", "turn", "role", "kind", "blank", "truncated", "text")
    return read.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in columns))


def reports(table: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost, letters and result digest of its repair.

    ``table`` has ``conv_id, turn, role, text``; rows whose ``gone`` is true, if
    there is such a column, only name their conversation.
    """
    return _walked(table, True)


def repaired(table: DataFrame) -> DataFrame:
    """``conv_id, place, role, text, edit``: the rows of every repaired conversation."""
    return _walked(table, False)
