"""Chunked operators against the plain definition, with tiny chunks and gaps."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import fixed
from corvane.functions.records import render_messages
from corvane.operators.conversations import (
    chat_prompts,
    context_budget,
    export_transcript,
    history_prompts,
    history_segments,
    session_turns,
    to_messages,
    turn_pairs,
)
from corvane.operators.ordered import Running, next_row, running, sparse_chunks
from corvane.operators.scores import retention
from corvane.plans.converse import converse
from corvane.operators.telemetry import best_step, early_stop, loss_gap

SIZES = [2, 3, 7, 4096]


def random_turns(seed):
    rnd = random.Random(seed)
    rows = []
    for conv in range(6):
        turn = 0
        for _ in range(rnd.choice([1, 3, 12, 40])):
            turn += rnd.choice([1, 1, 1, 2, 9])
            role = rnd.choice(["user", "assistant", "user", "assistant", "system"])
            said = rnd.choice(["hi", "a b", " x. ", "  ", "what, now?", "é"])
            rows.append((conv, turn, role, f"{said}{turn}" if said.strip() else said))
    rnd.shuffle(rows)
    return rows


def by_conversation(rows):
    groups = {}
    for row in sorted(rows):
        groups.setdefault(row[0], []).append(row)
    return groups


def session(turns):
    """User turns with their answers, as a chat session would see them."""
    out = []
    for i, (conv, turn, role, said) in enumerate(turns):
        if role == "user" and said.strip():
            answer = None
            if i + 1 < len(turns) and turns[i + 1][2] == "assistant":
                answer = turns[i + 1][3].strip()
            out.append((turn, said.strip(), answer))
    return out


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return random_turns(request.param)


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("size", SIZES)
def test_next_row(table, rows, size):
    got = {(r["conv_id"], r["turn"]): r["next"] for r in next_row(table, ["conv_id"], "turn", ["turn"], size).collect()}
    assert len(got) == len(rows)
    for conv, turns in by_conversation(rows).items():
        for this, after in zip(turns, turns[1:] + [None]):
            found = got[conv, this[1]]
            assert (found["turn"] if found else None) == (after[1] if after else None)


@pytest.mark.parametrize("size", SIZES)
def test_running_values(table, rows, size):
    value = F.when(F.col("role") != "system", F.length("text"))
    specs = {
        "s": Running("sum", value),
        "b": Running("sum", value, before=True),
        "lo": Running("min", value, before=True),
        "hi": Running("max", value),
        "first": Running("first", value),
        "last": Running("last", value, before=True),
    }
    got = {(r["conv_id"], r["turn"]): r for r in running(table, ["conv_id"], "turn", specs, size).collect()}
    for conv, turns in by_conversation(rows).items():
        seen = []
        for _, turn, role, said in turns:
            r = got[conv, turn]
            assert r["b"] == (sum(seen) if seen else None)
            assert r["lo"] == (min(seen) if seen else None)
            assert r["last"] == (seen[-1] if seen else None)
            if role != "system":
                seen.append(len(said))
            assert r["s"] == (sum(seen) if seen else None)
            assert r["hi"] == (max(seen) if seen else None)
            assert r["first"] == (seen[0] if seen else None)


@pytest.mark.parametrize("size", SIZES)
def test_history_prompts(table, rows, size):
    got = {(r["conv_id"], r["turn"]): r["prompt"] for r in history_prompts(table, size=size).collect()}
    want = {}
    for conv, turns in by_conversation(rows).items():
        history = []
        for turn, user, answer in session(turns):
            blocks = history[-10:] + [f"### Instruction:\n{user}"]
            want[conv, turn] = "\n\n".join(blocks) + "\n\n### Response:\n"
            if answer is not None:
                history += [f"### Instruction:\n{user}", f"### Response:\n{answer}"]
    assert got == want


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("limit", [30, 2048])
def test_chat_prompts(table, rows, size, limit):
    import re

    count = lambda s: len(re.findall(r"\w+|[^\w\s]", s))
    out = chat_prompts(table, "Be brief.", limit=limit, min_left=10, size=size)
    got = {(r["conv_id"], r["turn"]): (r["prompt_tokens"], r["prompt"]) for r in out.collect()}
    want, refused = {}, 0
    for conv, turns in by_conversation(rows).items():
        history = "System: Be brief.\n\n"
        for turn, user, answer in session(turns):
            prompt = f"{history}User: {user}\nAssistant:"
            fits = count(prompt) <= max(limit * 0.7, limit - 10)
            refused += not fits
            want[conv, turn] = (count(prompt), prompt if fits else None)
            if answer is not None:
                history += f"User: {user}\nAssistant: {answer}\n\n"
    assert got == want
    assert bool(refused) == (limit == 30)


def test_every_prompt_has_its_text_without_a_limit(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"word{t} " * 40) for t in range(120)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_prompts(df, size=16)
    assert out.count() == 60 and out.filter("prompt IS NULL").isEmpty()
    told = context_budget(chat_prompts(df, limit=1000, min_left=500, size=16), limit=1000, min_left=500)
    assert told.filter("(prompt IS NULL) <> (status = 'rejected')").isEmpty()
    assert {"ok", "rejected"} <= {r["status"] for r in told.collect()}


def test_a_long_conversation_is_one_row(spark):
    df = spark.range(5000).selectExpr("7L AS conv_id", "id AS turn", "'user' AS role", "'hi' AS text")
    row = to_messages(df).collect()
    assert len(row) == 1 and len(row[0]["messages"]) == 5000
    script = export_transcript(df.withColumn("role", F.expr("if(turn % 2 = 0, 'user', 'assistant')")), "m", "d")
    assert script.count() == 1 and script.first()["transcript"].count("User: ") == 2500


def test_session_commands(spark):
    said = [
        ("user", "hi"), ("assistant", "exit"), ("user", "more"), ("assistant", "yes"), ("user", "Context "),
        ("assistant", "noted"), ("user", "alone"), ("assistant", "a"), ("user", "context"), ("user", "again"),
        ("assistant", "b"), ("user", "clear"), ("user", "new"), ("assistant", "c"), ("user", "last"), ("user", "quit"),
        ("user", "gone"),
    ]
    df = spark.createDataFrame([(1, t, *x) for t, x in enumerate(said)], "conv_id long, turn long, role string, text string")
    turns = session_turns(df).collect()
    assert [(r["user"], r["assistant"], r["segment"], r["context_on"]) for r in sorted(turns, key=lambda r: r["turn"])] == [
        ("hi", "exit", 0, True), ("more", "yes", 0, True), ("alone", "a", 0, False), ("again", "b", 0, True),
        ("new", "c", 1, True), ("last", None, 1, True),
    ]
    made = converse(df, lambda: lambda prompts: list(prompts)).orderBy("turn").collect()
    told = {r["turn"]: r["prediction"] for r in made}
    assert told[6] == "User: alone\nAssistant:" and "User: alone" in told[9] and told[12] == "User: new\nAssistant:"
    assert told[9].startswith("User: hi\nAssistant: exit\n\nUser: more") and len(told) == 6


@pytest.mark.parametrize("size", [3, 50])
def test_sparse_order_and_null_keys(spark, size):
    rnd = random.Random(7)
    rows = []
    for run in ("a", None, "b"):
        # Far apart, and some close together in one place.
        steps = sorted(rnd.sample(range(-(10**12), 10**12), 150) + list(range(5 * 10**11, 5 * 10**11 + 300)))
        rows += [(run, step, rnd.random()) for step in dict.fromkeys(steps)]
    df = spark.createDataFrame(rows, "run string, step long, value double")
    cut = sparse_chunks(df, ["run"], "step", size)
    per = cut.groupBy("run", "_chunk").count()
    assert per.agg(F.max("count")).first()[0] <= 2 * size and per.count() < 3 * 450 / size * 4 + 12
    got = running(cut, ["run"], "step", {"n": Running("sum", F.lit(1)), "lo": Running("min", F.col("value"))})
    for run in ("a", None, "b"):
        own = [r for r in got.collect() if r["run"] == run]
        least = 9.0
        for i, r in enumerate(sorted(own, key=lambda r: r["step"]), 1):
            least = min(least, r["value"])
            assert (r["n"], r["lo"]) == (i, least)


def test_early_stop_is_the_same_without_a_name(spark):
    values = [5.0, 4.0, 4.1, 4.2, 4.3, 3.0]
    rows = [(run, i * 10_000, "eval_loss", v) for run in ("a", None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "run string, step long, metric string, value double")
    for size in (1, 2, 100):
        assert {r["stop_step"] for r in early_stop(df, "eval_loss", 3, size=size).collect()} == {40_000}


def test_positions_below_zero_are_an_error(spark):
    df = spark.createDataFrame([(1, -1, "user", "x")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="counts from 0"):
        turn_pairs(df).collect()


def test_chat_without_context(table):
    row = chat_prompts(table, context=False).orderBy("conv_id", "turn").first()
    assert row["prompt"].startswith("User: ") and row["prompt"].endswith("\nAssistant:")


@pytest.mark.parametrize("size", SIZES)
def test_parts_join_to_the_whole(table, rows, size):
    parts = to_messages(table, size)
    assert parts.filter(F.size("messages") > size).isEmpty()
    got = {}
    for r in parts.orderBy("conv_id", "part").collect():
        got.setdefault(r["conv_id"], []).extend((m["role"], m["content"]) for m in r["messages"])
    assert got == {c: [(t[2], t[3]) for t in turns] for c, turns in by_conversation(rows).items()}
    script = {}
    for r in export_transcript(table, "m", "d", size).orderBy("conv_id", "part").collect():
        script[r["conv_id"]] = script.get(r["conv_id"], "") + r["transcript"]
    for conv, turns in by_conversation(rows).items():
        pairs = [(u, a) for _, u, a in session(turns) if a is not None]
        if not pairs:
            assert conv not in script
            continue
        body = "".join(f"User: {u}\nAssistant: {a}\n{'-' * 80}\n" for u, a in pairs)
        assert script[conv] == f"Conversation Log\nModel: m\nDate: d\n{'=' * 80}\n\n" + body
    assert turn_pairs(table, size).count() == sum(
        a is not None for t in by_conversation(rows).values() for _, _, a in session(t)
    )


def test_messages_render(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    assert to_messages(df).select(render_messages(F.col("messages"))).first()[0] == "### User:\nhi\n\n### Assistant:\nyo"


@pytest.mark.parametrize("size", SIZES)
def test_segments(spark, size):
    said = ["a", " CLEAR ", "b", "context", "c", "", "save", "context", "clear", "d", "Quit", "e", "clear", "f"]
    rows = [(1, 3 * i, s) for i, s in enumerate(said)] + [(2, 5, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = sorted((r["conv_id"], r["text"], r["segment"], r["context_on"]) for r in history_segments(df, size=size).collect())
    assert got == [(1, "a", 0, True), (1, "b", 1, True), (1, "c", 1, False), (1, "d", 2, True), (2, "x", 0, True)]


def test_budget(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1433, 1434, 1536, 1537, 1948, 1949, 3000)], "prompt_tokens long")
    got = [r["status"] for r in context_budget(df).collect()]
    assert got == ["ok", "ok", "long", "long", "short_reply", "short_reply", "rejected", "rejected"]


def metric_rows(seed):
    rnd = random.Random(seed)
    return [
        (run, step, metric, round(rnd.uniform(0.2, 2.0), 2))
        for run in range(4)
        for step in sorted(rnd.sample(range(60), 25))
        for metric in rnd.sample(["loss", "eval_loss"], rnd.choice([1, 2]))
    ]


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("patience,threshold", [(1, 0.0), (2, 0.3), (3, 0.001)])
def test_early_stop(spark, size, patience, threshold):
    rows = metric_rows(3)
    df = spark.createDataFrame(rows, "run long, step long, metric string, value double")
    got = {r["run"]: r["stop_step"] for r in early_stop(df, "eval_loss", patience, threshold, size=size).collect()}
    for run in range(4):
        best, waited, stop = None, 0, None
        for _, step, _, v in sorted(r for r in rows if r[0] == run and r[2] == "eval_loss"):
            if best is None or (v < best and abs(v - best) > threshold):
                waited = 0
            else:
                waited += 1
            best = v if best is None else min(best, v)
            if waited >= patience and stop is None:
                stop = step
        assert got[run] == stop


@pytest.mark.parametrize("size", SIZES)
def test_loss_gap(spark, size):
    rows = metric_rows(4)
    df = spark.createDataFrame(rows, "run long, step long, metric string, value double")
    got = {(r["run"], r["step"]): (r["train_loss"], r["overfit"]) for r in loss_gap(df, size=size).collect()}
    for run in range(4):
        mine = [r for r in rows if r[0] == run]
        for _, step, metric, v in mine:
            if metric == "eval_loss":
                train = [(s, x) for _, s, m, x in mine if m == "loss" and s <= step]
                last = max(train)[1] if train else None
                assert got[run, step] == (last, last is not None and v - last > 0.5)


def test_best_step(spark):
    rows = [(1, 10, "eval_loss", 0.5), (1, 20, "eval_loss", 0.3), (1, 30, "eval_loss", 0.3), (1, 5, "loss", 0.1)]
    df = spark.createDataFrame(rows, "run long, step long, metric string, value double")
    assert tuple(best_step(df, "eval_loss").first()) == (1, 20, 0.3)
    assert tuple(best_step(df, "eval_loss", lower=False).first()) == (1, 10, 0.5)


def test_retention(spark):
    rows = [("a", 1, 80.0), ("a", 2, 76.0), ("a", 3, 75.9), ("b", 2, 50.0)]
    df = spark.createDataFrame(rows, "domain string, stage long, score double")
    got = {(r["domain"], r["stage"]): r["retained"] for r in retention(df, ["domain"], "stage", "score").collect()}
    assert got == {("a", 1): True, ("a", 2): True, ("a", 3): False, ("b", 2): True}


def test_fixed_history_size():
    assert fixed.HISTORY_PAIRS == 5
