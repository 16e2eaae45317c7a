"""Repairs against all edit scripts of small conversations, and a plain version of the query."""

import hashlib
import heapq
import os
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import repair
from corvane.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, digest string, kind int"


def cheapest(rows):
    """Least (cost, letters) by a best-first search over all scripts; ``rows`` are (role, must go, truncated)."""
    queue = [(0, "", 0, "")]
    while True:
        cost, letters, at, roles = heapq.heappop(queue)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters
        for initial in "ua":
            queue_put(queue, cost + 5, letters + "I", at, roles + initial)
        if at < len(rows):
            role, must_go, late = rows[at]
            queue_put(queue, cost + 2, letters + "D", at + 1, roles)
            if not must_go:
                queue_put(queue, cost + 5 * late, letters + "K", at + 1, roles + role[:1])
                for initial in "ua":
                    queue_put(queue, cost + 1 + 5 * late, letters + "R", at + 1, roles + initial)


def queue_put(queue, cost, letters, at, roles):
    if re.fullmatch("s?(ua)*u?", roles):
        heapq.heappush(queue, (cost, letters, at, roles))


def test_scripts_are_the_least_of_all():
    draw, back = random.Random(1), repair.Backward()
    for _ in range(1500):
        rows = [
            (draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "User"]), draw.random() < 0.2, draw.random() < 0.3)
            for _ in range(draw.randint(0, 6))
        ]
        codes = bytes(repair.code_of(*r) for r in rows)
        assert repair.script(codes, back) == cheapest(rows), rows


def test_a_long_conversation_is_its_whole_table():
    """Checkpoints change nothing: the walk over a full table of costs gives the same letters."""
    draw, back = random.Random(2), repair.Backward()
    codes = bytes(draw.randrange(repair.FORCED + 1) for _ in range(20_000))
    table = [repair.END]
    for code in reversed(codes):
        norm, least = back(code, tuple(c - min(table[-1]) for c in table[-1]))
        table.append(tuple(c + least + min(table[-1]) for c in norm))
    table.reverse()
    letters, state, at = [], 0, 0
    while at < len(codes) or repair.END[state]:
        options = [("I", 5, repair.NEXT[state], at)]
        if at < len(codes):
            options += [(x, cost, to, at + 1) for x, cost, to in repair.EDITS[codes[at]][state]]
        letter, _, state, at = min(o for o in options if o[1] + table[o[3]][o[2]] == table[at][state])
        letters.append(letter)
    assert repair.script(codes, back) == (table[0][0], "".join(letters))


def plain(table):
    """The query's result in plain Python."""
    rows = defaultdict(list)
    for conv, turn, role, text in table:
        rows[conv]
        name = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in rows.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults, tries = set(), [], []
        for _, role, text in own:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            tries.append((role, fault in ("blank", "duplicate"), fault == "truncated"))
        cost, letters = cheapest(tries)
        done, state, rest = [], "", iter(own)
        for letter in letters:
            role, text = next(rest)[1:] if letter != "I" else ("", "")
            if letter == "D":
                continue
            if letter in "IR":
                role = "assistant" if state == "u" else "user"
            state = role[:1] or state
            done.append(f"{role}:{text}")
        turns = {r[0] for r in own} - {None}
        initials = [r[1][:1] for r in own]
        out[conv] = {
            "conv_id": conv,
            "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "cost": cost,
            "audit": letters,
            "repaired_sha256": hashlib.sha256("\n".join(done).encode()).hexdigest(),
        }
    return out


def compare(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {r["conv_id"]: r.asDict() for r in repair.reports(repair.damaged(df)).collect()}
    assert got == plain(rows)
    return df


def test_conversations_with_nulls_ties_and_repeats(spark):
    draw = random.Random(3)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown"]
    texts = ["Yes.", "No!", "Why", "", " \t", None, "Mmm ...\n", "cut off,", "é?", "a\nb."]
    rows = []
    for conv in [*range(150), None]:
        for _ in range(draw.randint(1, 7)):
            rows.append((conv, draw.choice([None, *range(9)]), draw.choice(roles), draw.choice(texts)))
    rows += [(1000 + i, 0, "user", "Alone.") for i in range(40)]  # some of these lose their only row
    df = compare(spark, rows)
    assert any(zlib.crc32(f"{c}:0".encode()) % 20 == 0 for c in range(1000, 1040))
    assert repair.reports(repair.damaged(df.limit(0))).collect() == []


def test_repaired_rows_are_what_the_digest_says(spark):
    rows = [(c, t, ["user", "assistant"][(t + c) % 2], f"Text {t} of {c}." * 3) for c in range(60) for t in range(c % 9 + 1)]
    table = repair.damaged(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    made = defaultdict(list)
    for r in repair.repaired(table).orderBy("conv_id", "place").collect():
        assert len(made[r["conv_id"]]) == r["place"]
        made[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for r in repair.reports(table).collect():
        assert hashlib.sha256("\n".join(made[r["conv_id"]]).encode()).hexdigest() == r["repaired_sha256"]
        initials = "".join(x[0] for x in made[r["conv_id"]])
        assert re.fullmatch("(s?(ua)+)?", initials)


def test_one_long_conversation(spark):
    rows = spark.range(30_000).select(
        F.lit(1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") % 10 == 9, "the same.").otherwise(F.concat(F.lit("t"), "id", F.lit("."))).alias("text"),
    )
    (got,) = repair.reports(rows).collect()
    assert got["duplicate"] == 2999 and len(got["audit"]) >= 30_000 and got["gaps"] == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="tables are not there")
def test_query_against_the_plain_version(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    want = plain([tuple(r) for r in table.collect()])
    assert {r["conv_id"]: r.asDict() for r in QUERIES["op13_conversation_repair"][0](spark, folder).collect()} == want
