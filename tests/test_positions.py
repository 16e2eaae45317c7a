"""Lines that meet by their place, whatever files and ranges they come in."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators.positions import LengthError, attach_by_position, with_position
from corvane.session import staged
from corvane.sources import files


def write(folder, sizes, line):
    folder.mkdir()
    n = 0
    for i, size in enumerate(sizes):
        with open(folder / f"part-{i:02d}.jsonl", "w") as out:
            for _ in range(size):
                out.write(line(n) + "\n")
                n += 1
    return files.read_jsonl, f"{folder}/*.jsonl"


def lines(spark, source, size):
    """The lines, in ranges of a size; stored, because the setting counts while they are read."""
    read, pattern = source
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        return staged(read(spark, pattern), "lines")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_predictions_meet_their_pairs(spark, tmp_path):
    pairs = write(tmp_path / "pairs", [500, 0, 1, 999], lambda n: json.dumps({"n": n, "pad": "x" * (n % 83)}))
    answers = write(tmp_path / "answers", [3, 1200, 297], lambda n: f"answer {n}")
    met = attach_by_position(lines(spark, pairs, "9000"), lines(spark, answers, "2000"))
    got = {json.loads(r["line"])["n"]: (r["position"], r["prediction"]) for r in met.collect()}
    assert got == {n: (n, f"answer {n}") for n in range(1500)}


def test_pairs_that_were_filtered_count_anew(spark, tmp_path):
    pairs = write(tmp_path / "pairs", [400, 300], lambda n: json.dumps({"n": n}))
    number = F.get_json_object("line", "$.n").cast("int")
    rows = lines(spark, pairs, "1000").withColumn("n", number).filter((F.col("n") % 3 != 1) | (F.col("n") > 600))
    kept = [n for n in range(700) if n % 3 != 1 or n > 600]
    assert {r["n"]: r["position"] for r in with_position(rows).collect()} == {n: i for i, n in enumerate(kept)}
    answers = write(tmp_path / "answers", [len(kept)], lambda n: f"a{n}")
    met = attach_by_position(rows, lines(spark, answers, "500"))
    assert {r["n"]: r["prediction"] for r in met.collect()} == {n: f"a{i}" for i, n in enumerate(kept)}


def test_other_lengths_are_an_error(spark, tmp_path):
    pairs = write(tmp_path / "pairs", [10], str)
    for name, size in (("few", 9), ("many", 11)):
        answers = write(tmp_path / name, [size], str)
        with pytest.raises(LengthError, match=f"{size} predictions for 10 pairs"):
            attach_by_position(lines(spark, pairs, "1m"), lines(spark, answers, "1m"))


def test_empty(spark, tmp_path):
    none = write(tmp_path / "none", [0], str)
    assert attach_by_position(lines(spark, none, "1m"), lines(spark, none, "1m")).collect() == []
