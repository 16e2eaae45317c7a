"""Files that arrive are of a bounded size, and hold every record."""

import os

from suite import sources

TABLES = "/root/testdata/sf0.001"


def test_files_follow_the_length_of_the_texts(spark, monkeypatch):
    count = lambda folder: sum(n.startswith("part-") for n in os.listdir(folder.removeprefix("file:")))
    assert count(sources._arriving(spark, TABLES)) == 4
    monkeypatch.setattr(sources, "ARRIVING", 20_000)
    folder = sources._arriving(spark, TABLES)
    size = spark.read.parquet(f"{TABLES}/documents.parquet").agg({"n_chars": "sum"}).first()[0]
    assert count(folder) == -(-size // 20_000) > 4
    assert spark.read.text(folder).count() == spark.read.parquet(f"{TABLES}/documents.parquet").count()
