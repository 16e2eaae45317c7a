"""JSON lists in byte ranges against a parser that has the whole file."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corvane.sources import files


@pytest.fixture
def small_ranges(spark):
    """Ranges of some hundred bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def set_to(size):
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], "0")
        spark.conf.set(keys[2], "1")

    yield set_to
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def value(draw, depth=0):
    kind = draw.randint(0, 9 if depth < 3 else 5)
    if kind == 0:
        return draw.choice([None, True, False, 0, -1.5e3, 12345])
    if kind < 6:
        signs = ['"', "\\", "[", "]", "{", "}", ",", ":", "\n", "é", "漢", "🙂", " ", "a", "\\\\", '\\"', "/"]
        return "".join(draw.choices(signs, k=draw.randint(0, 14)))
    if kind < 8:
        return [value(draw, depth + 1) for _ in range(draw.randint(0, 4))]
    return {f"k{i}{draw.choice(',]}[{')}": value(draw, depth + 1) for i in range(draw.randint(0, 4))}


@pytest.mark.parametrize("size", ["97", "64k"])
def test_elements_are_a_parsers(spark, small_ranges, tmp_path, size):
    draw, want = random.Random(size), {}
    for n in range(4):
        rows = [{"n": i, "v": value(draw)} for i in range(draw.choice([0, 1, 2, 40]))] + [value(draw)] * (n % 2)
        rows += [["x" * 700, ",".join("y" * 300)]] * (n % 3)
        indent = draw.choice([None, None, 1])
        path = tmp_path / f"list{n}.json"
        path.write_text(draw.choice(["", "\n "]) + json.dumps(rows, indent=indent, ensure_ascii=n % 2 == 0) + draw.choice(["", "\n\n"]))
        want[path.name] = rows
    small_ranges(size)
    found = files.read_lines(spark, [str(tmp_path / name) for name in sorted(want)])
    got = {name: [] for name in want}
    numbered = files.number_lines(found)
    for r in sorted(numbered.collect(), key=lambda r: (r["file"], r["number"])):
        own = got[r["file"].rsplit("/", 1)[-1]]
        own.append(json.loads(r["line"]))
        assert r["number"] == len(own)
    assert got == want
    if size == "97":
        ranges = files.json_lists.pieces(spark, [str(tmp_path / "list3.json")]).select("block").distinct().count()
        assert ranges > 5


def test_what_is_no_list_gives_its_lines(spark, small_ranges, tmp_path):
    texts = {
        "after.json": '[1, 2]\n{"a": 1}\n',
        "open.json": '[{"a": 1},\n{"b": 2}\n',
        "twice.json": "[1] [2]\n",
        "closed.json": "[1]]\n",
        "quote.json": '["a]\n',
        "lines.json": '{"a": [1, 2]}\n{"b": "]"}\n',
        "comma.json": "[1],\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    small_ranges("5")
    found = files.read_lines(spark, [str(tmp_path / n) for n in texts])
    got = {n: [] for n in texts}
    for r in found.orderBy("file", "block", "seq").collect():
        got[r["file"].rsplit("/", 1)[-1]].append(r["line"])
    assert got == {n: t.rstrip("\n").split("\n") for n, t in texts.items()}


def test_a_long_line_is_never_one_value(spark, small_ranges, tmp_path):
    rows = [{"i": i, "t": "[{\"" * (i % 5)} for i in range(20_000)]
    path = tmp_path / "one.json"
    path.write_text(json.dumps(rows))
    small_ranges("64k")
    found = files.read_lines(spark, [str(path)])
    lines = found.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("line")).alias("longest")).first()
    assert lines["n"] == 20_000 and lines["longest"] < 100
    pieces = files.json_lists.pieces(spark, [str(path)])
    assert pieces.agg(F.max(F.octet_length("piece"))).first()[0] < 100
    assert pieces.select("block").distinct().count() == -(-path.stat().st_size // 65536)


def test_compressed_and_empty(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        json.dump([{"a": 1}, {"b": "x,]"}], f)
    (tmp_path / "b.json").write_text("")
    (tmp_path / "c.json").write_text(" [ ] ")
    found = files.read_lines(spark, [str(tmp_path / n) for n in ("a.json.gz", "b.json", "c.json")]).collect()
    assert sorted(r["line"] for r in found) == ['{"a": 1}', '{"b": "x,]"}']


def test_lists_beside_lines_are_whole(spark, small_ranges, tmp_path):
    """How Spark cuts a file depends on all that is read with it; lists were once read with and without the lines beside them."""
    rows = [{"i": i, "t": "a, b] " * (i % 7)} for i in range(4_000)]
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "lines.json").write_text("".join(json.dumps({"i": i}) + " " * 60 + "\n" for i in range(4_000, 9_000)))
    small_ranges("4m")
    spark.conf.set("spark.sql.files.minPartitionNum", "10")
    found = files.read_lines(spark, [str(tmp_path / n) for n in ("list.json", "lines.json")])
    # Nor does it matter that it is cut otherwise when the rows are read at last.
    spark.conf.set("spark.sql.files.minPartitionNum", "3")
    assert sorted(json.loads(r["line"])["i"] for r in found.collect()) == list(range(9_000))


@pytest.mark.parametrize("size", [1, 40, 1000])
def test_elements_across_chunks(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(files.json_lists, "CHUNK", size)
    draw, want = random.Random(5), {}
    for n in range(6):
        want[f"list{n}.json"] = [value(draw) for _ in range((0, 1, 30, 40, 50, 60)[n])] + ["\\" * n + '"', ",,,"] * (n % 2)
        (tmp_path / f"list{n}.json").write_text(json.dumps(want[f"list{n}.json"], ensure_ascii=n % 2 == 0))
    (tmp_path / "after.json").write_text("[1,2],  \n")
    numbered = files.number_lines(files.read_lines(spark, [str(tmp_path / n) for n in [*want, "after.json"]]))
    got = {n: [] for n in want} | {"after.json": []}
    for r in sorted(numbered.collect(), key=lambda r: (r["file"], r["number"])):
        got[r["file"].rsplit("/", 1)[-1]].append(r["line"])
    assert got.pop("after.json") == ["[1,2],  "]
    assert {n: [json.loads(x) for x in lines] for n, lines in got.items()} == want


def test_small_splits_share_tasks(spark, small_ranges, tmp_path):
    (tmp_path / "a.txt").write_text("some line\n" * 5_000)
    (tmp_path / "a.json").write_text(json.dumps(["some, line"] * 5_000))
    small_ranges("500")
    lines = files.read_lines(spark, [str(tmp_path / "a.txt")])
    pieces = files.json_lists.pieces(spark, [str(tmp_path / "a.json")])
    slots = spark.sparkContext.defaultParallelism
    for read, blocks in ((lines, 100), (pieces, 140)):
        assert read.rdd.getNumPartitions() <= 4 * slots
        assert read.select("block").distinct().count() == blocks
    assert files.number_lines(lines).agg(F.max("number")).first()[0] == 5_000
