import json
import os
import random
import time

from pyspark.sql import functions as F

from corvane.operators.conversations import history_prompts
from corvane.operators.examples import render, validate
from corvane.operators.ingest import count_reasons, ingest, with_record
from corvane.operators.telemetry import best_step, early_stop, parse_log
from corvane.session import scratch_dir
from corvane.streaming import examples as arriving_examples, sinks, stopping
from corvane.streaming.examples import stream_ingest, stream_lines, stream_prepare
from corvane.streaming.history import OUTPUT, stream_history, stream_messages
from corvane.streaming.metrics import stream_log_lines, stream_metrics
from test_ordered import random_turns


def drain(spark, rows, out):
    stream = rows.writeStream.format("parquet").option("checkpointLocation", scratch_dir(spark, "progress"))
    running = stream.trigger(availableNow=True).start(out)
    running.awaitTermination()
    return spark.read.parquet(out), running.recentProgress


def test_prepare_stream_equals_batch(spark):
    lines = [json.dumps({"text": f"t{i}"}) if i % 4 else "{bad" for i in range(40)] + [json.dumps({"text": " "})]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    source = scratch_dir(spark, "in")
    df.repartition(5).write.text(source)
    got, progress = drain(spark, stream_prepare(stream_lines(spark, source, 2), 100, permissive=True), scratch_dir(spark, "out"))
    want = validate(render(ingest(df).good), 100)
    assert len(progress) >= 3
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


TURNS = "conv_id long, turn long, role string, text string"


def arrive(spark, parts):
    """Files of messages, in the order in which they are to be read."""
    source = scratch_dir(spark, "in")
    for part in parts:
        df = part if hasattr(part, "write") else spark.createDataFrame(part, TURNS)
        df.coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.02)  # files are read by their time
    return source


def by_kind(rows):
    found = {}
    for r in rows.collect():
        found.setdefault(r["kind"], []).append((r["conv_id"], r["turn"], r["prompt"]))
    return {k: sorted(v, key=str) for k, v in found.items()}


def test_history_stream_equals_batch_in_any_order(spark):
    """Messages arrive over several triggers, out of order; the state carries history and what waits."""
    rows = [(c, t, r, x) for c, t, r, x in random_turns(4) if c is not None]
    least = {}
    for c, t, *_ in rows:
        least[c] = min(t, least.get(c, t))
    turns = {c: sorted(t for k, t, *_ in rows if k == c) for c in least}
    rows = [(c, turns[c].index(t), r, x) for c, t, r, x in rows]  # turns without gaps
    draw = random.Random(3)
    arriving = sorted(rows, key=lambda r: r[1] + draw.uniform(0, 30))
    size = len(arriving) // 6 + 1
    source = arrive(spark, [arriving[i : i + size] for i in range(0, len(arriving), size)])
    got, progress = drain(spark, stream_history(stream_messages(spark, source, 1), idle=None), scratch_dir(spark, "out"))
    assert sum(p["numInputRows"] > 0 for p in progress) >= 3
    want = history_prompts(spark.createDataFrame(rows, TURNS))
    assert by_kind(got) == {"prompt": sorted(map(tuple, want.collect()), key=str)}


def test_replayed_and_late_messages_are_rows_of_their_own(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"m{t}") for t in range(12)]
    parts = [
        [r for r in rows[:4]] + [rows[2]],  # a replay within the trigger
        [rows[1], rows[6], rows[7], (1, None, "user", "?")],  # 4 and 5 are missing
        [rows[9], rows[8], rows[8]],  # 9 gives up turns 4 and 5 with a window of 4
        [rows[4], rows[5], rows[4], rows[10]],  # too late
    ]
    source = arrive(spark, parts)
    arriving = stream_messages(spark, source, 1)
    got = by_kind(drain(spark, stream_history(arriving, idle=None, window=4), scratch_dir(spark, "out"))[0])
    assert got["late"] == [(1, 4, None), (1, 5, None), (1, None, None)]
    assert got["repeated"] == [(1, 1, None), (1, 2, None), (1, 4, None), (1, 8, None)]
    known = [r for r in rows[:11] if r[1] not in (4, 5)]
    want = history_prompts(spark.createDataFrame(known, TURNS))
    assert got["prompt"] == sorted(map(tuple, want.collect()), key=str)
    given = sum(len(p) for p in parts)
    answered = sum(r[2] == "assistant" for r in known)
    assert sum(map(len, got.values())) == given - answered  # none vanishes


def test_idle_conversations_are_released_by_a_timer(spark):
    source = arrive(spark, [[(1, 0, "user", "a"), (1, 2, "user", "c"), (1, 5, "user", "f")]])
    rows = stream_history(stream_messages(spark, source, 1), idle="2 seconds")
    out = scratch_dir(spark, "out")
    running = rows.writeStream.format("parquet").option("checkpointLocation", scratch_dir(spark, "progress")).start(out)
    try:
        for _ in range(120):
            time.sleep(0.5)
            if os.path.isdir(f"{out}/_spark_metadata") and spark.read.schema(OUTPUT).parquet(out).count() == 3:
                break
    finally:
        running.stop()
    assert [t for _, t, _ in by_kind(spark.read.schema(OUTPUT).parquet(out))["prompt"]] == [0, 2, 5]


def test_metric_stream_drops_repeats(spark, tmp_path):
    head = "2024-05-01 10:00:0{} | INFO     | m:f:1 - Step {} | loss: {}.5"
    text = "\n".join(head.format(i, i, i) for i in range(5))
    for name in ("run_a.log", "run_a.1.log", "run_b.log"):
        (tmp_path / name).write_text(text + "\n")
    rows = stream_metrics(stream_log_lines(spark, str(tmp_path)), "1 hour")
    got, _ = drain(spark, rows, scratch_dir(spark, "out"))
    lines = spark.createDataFrame([(r, x) for r in ("run_a", "run_b") for x in text.split("\n")], "run string, line string")
    want = parse_log(lines)
    key = ["run", "step", "metric", "value"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_rejects_and_counts_of_a_stream_equal_the_batch(spark, monkeypatch):
    lines = [json.dumps({"text": f"t{i}"}) if i % 4 else "{bad" for i in range(40)]
    lines += [json.dumps({"text": " "}), json.dumps({"odd": 1}), "", json.dumps({"instruction": "a", "output": "b"})]
    source, out, progress = scratch_dir(spark, "in"), scratch_dir(spark, "out"), scratch_dir(spark, "progress")
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    df.repartition(4).write.text(source)
    arriving = stream_lines(spark, source, 1)

    def run():
        stream_ingest(arriving, out, progress, 100, permissive=True, availableNow=True).awaitTermination()

    # The second trigger fails between its two writes; the next run plays it again.
    write, calls = sinks.write_batch, []

    def failing(rows, path, number, *by):
        calls.append(path)
        if len(calls) == 4:
            raise OSError("disk gone")
        write(rows, path, number, *by)

    monkeypatch.setattr(arriving_examples, "write_batch", failing)
    try:
        run()
    except Exception as error:
        assert "disk gone" in str(error)
    run()
    assert sum(p.endswith("counts") for p in calls) > 3
    tagged = with_record(df, permissive=True)
    want = validate(render(ingest(df).good), 100)
    good = arriving_examples.examples(spark, out)
    assert sorted(map(tuple, good.select("text", "overlong").collect())) == sorted(map(tuple, want.collect()))
    bad = arriving_examples.rejects(spark, out).groupBy("reason").count().collect()
    reasons = tagged.filter("reason IS NOT NULL").groupBy("reason").count().collect()
    assert sorted(map(tuple, bad)) == sorted([*map(tuple, reasons), ("empty", 1)])
    total = arriving_examples.counts(spark, out).first()
    assert tuple(total)[:3] == tuple(count_reasons(tagged).first()) and total["empty_rows"] == 1
    assert good.count() + arriving_examples.rejects(spark, out).count() == len(lines)
    before = sorted(map(tuple, good.collect()))
    run()  # nothing new
    assert sorted(map(tuple, arriving_examples.examples(spark, out).collect())) == before


def test_live_early_stop_equals_the_batch_after_every_trigger(spark):
    draw = random.Random(6)
    schema = "run string, step long, metric string, value double"
    rows = [
        (run, step, metric, draw.choice([draw.random(), 0.5, 0.5, float("nan")]))
        for run in ("a", "b", "c", None)
        for step in range(0, 400, draw.choice([7, 20]))
        for metric in ("eval_loss", "loss")
    ]
    source, out, progress = (scratch_dir(spark, x) for x in ("in", "out", "progress"))
    spark.createDataFrame([], schema).write.parquet(source)
    arriving = spark.readStream.schema(schema).parquet(source)
    done = 0
    for upto in (100, 101, 230, 400):
        part = [r for r in rows if done <= r[1] < upto]
        done = upto
        draw.shuffle(part)
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        changes = stopping.stream_early_stop(arriving, "eval_loss", 3, 0.001)
        stopping.keep_current(changes, out, progress, availableNow=True).awaitTermination()
        known = spark.read.parquet(source)
        stops = {r["run"]: (r["evaluations"], r["stop_step"]) for r in early_stop(known, "eval_loss", 3, 0.001).collect()}
        bests = {r["run"]: (r["best_step"], str(r["best_value"])) for r in best_step(known, "eval_loss").collect()}
        got = stopping.current(spark, out, "run").collect()
        assert {r["run"]: (r["evaluations"], r["stop_step"]) for r in got} == stops
        assert {r["run"]: (r["best_step"], str(r["best_value"])) for r in got} == bests
        assert {r["late"] for r in got} == {0}
    # A repeated line and a late one are counted and change nothing else.
    spark.createDataFrame([("a", 0, "eval_loss", -1.0), ("a", 1, "eval_loss", -9.0)], schema).write.mode("append").parquet(source)
    stopping.keep_current(stopping.stream_early_stop(arriving, "eval_loss", 3, 0.001), out, progress, availableNow=True).awaitTermination()
    got = {r["run"]: r for r in stopping.current(spark, out, "run").collect()}
    assert got["a"]["late"] == 2 and (got["a"]["evaluations"], got["a"]["stop_step"]) == stops["a"]
