"""Locators, catalogs, sinks and streams over files made from the tables."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Window, functions as F

from corvane.operators.ingest import parse_record
from corvane.operators.scores import identify_runs
from corvane.session import scratch_dir, staged
from corvane.sources import arrow, catalog, files, locator, sinks
from corvane.streaming import examples as arriving, stopping
from corvane.streaming.examples import stream_lines, stream_prepare as prepare_stream
from corvane.streaming.history import stream_history as history_stream, stream_messages
from corvane.streaming.metrics import stream_metrics as metrics_stream
from suite.dialogs import HISTORY_SQL
from suite.examples import VALID_SQL
from suite.inputs import (
    WS,
    LOG_SQL,
    PAIRS_SQL,
    document_json,
    load,
    log_lines,
    metric_rows,
    move_one,
    name_as_json,
    predictions,
    record_lines,
    sharded_documents,
)
from suite.registry import query
from suite.runs import EARLY_STOP_SQL

LIST_BYTES = 16 << 20  # about so much text goes into one JSON list
ARRIVING = 64 << 20  # about so many characters arrive in one file
DOCS_SQL = "SELECT doc_id, md5(text) AS digest FROM documents"


def _digests(lines):
    record = lines.select(parse_record(F.col("line")).alias("r"))
    return record.select(F.col("r")["doc_id"].cast("long").alias("doc_id"), F.md5(F.col("r")["text"]).alias("digest"))


@query(f"{DOCS_SQL} WHERE lang <> 'en'")
def src_locator(spark, sf):
    directory = sharded_documents(spark, sf)
    return _digests(locator.read_dataset(spark, f"hf_files:{directory}:test"))


@query(DOCS_SQL)
def src_jsonl(spark, sf):
    directory = scratch_dir(spark, "jsonl")
    document_json(spark, sf).select("lang", "line").write.partitionBy("lang").text(directory)
    return _digests(files.read_jsonl(spark, f"{directory}/**/*.txt"))


@contextmanager
def _ranges(spark, size):
    """Files are read in splits of this size; what is read has to be stored inside."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _json_lists(spark, sf):
    """Folder of JSON lists per language, some pretty, some on one line, beside files of lines with the same suffix."""
    directory = scratch_dir(spark, "json-lists")
    docs = document_json(spark, sf).select("lang", "doc_id", "line")
    plain = F.col("lang").eqNullSafe("en")
    docs.filter(plain).select("line").write.text(f"{directory}/raw/lines")
    others = docs.filter(~plain)
    # As many lists as the texts' length asks for; the line is in the digest for rows that share an id or have none.
    sizes = others.groupBy(F.col("lang").alias("of")).agg(F.ceil(F.sum(F.octet_length("line")) / LIST_BYTES).alias("lists"))
    dealt = others.join(sizes, F.col("lang").eqNullSafe(F.col("of")))
    dealt = dealt.withColumn("list", F.pmod(F.xxhash64("doc_id", "line"), "lists"))
    pretty = F.when(F.col("lang") == "fr", ",\n  ").otherwise(",")
    lists = dealt.groupBy("lang", "list", pretty.alias("gap")).agg(F.collect_list("line").alias("all"))
    text = F.concat(F.lit("[ "), F.array_join("all", "\x02"), F.lit("\n]\n"))
    lists = lists.select(F.replace(text, F.lit("\x02"), F.col("gap")).alias("value"), "lang", "list")
    lists.write.partitionBy("lang", "list").option("lineSep", " ").text(f"{directory}/raw/lists")
    name_as_json(spark, f"{directory}/raw")
    return directory


@query(DOCS_SQL)
def src_json_list(spark, sf):
    return _digests(files.read_jsonl(spark, f"{_json_lists(spark, sf)}/**/raw/**/*.json"))


@query(DOCS_SQL)
def src_json_ranges(spark, sf):
    """The same lists in ranges of 64 KB, so that elements lie across ranges."""
    directory = _json_lists(spark, sf)
    with _ranges(spark, "64k"):
        return staged(_digests(files.read_jsonl(spark, f"{directory}/**/raw/**/*.json")), "json-ranges")


@query("SELECT doc_id, lang, source, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS BIGINT) AS number FROM documents")
def src_line_numbers(spark, sf):
    """Line numbers do not depend on the splits; the texts here are read in splits of 64 KB.

    Each file is one language's part of a range of ids, so a number counts on from
    the files before it.
    """
    directory = scratch_dir(spark, "numbered")
    docs = document_json(spark, sf).select("lang", "source", "doc_id", "line")
    ranged = docs.repartitionByRange("lang", "source", "doc_id").sortWithinPartitions("lang", "source", "doc_id")
    ranged.select("lang", "source", "line").write.partitionBy("lang", "source").text(directory)
    with _ranges(spark, "64k"):
        rows = files.read_jsonl(spark, f"{directory}/**/*.txt")
        rows = rows.select(parse_record(F.col("line"))["doc_id"].cast("long").alias("doc_id"), "file", "block", "seq")
        rows = staged(rows, "places")
    # The texts are read once: lines are counted and numbered by what is stored of their places.
    rows = files.number_lines(rows)
    # Files of one group hold ranges of ids in order; a row per file.
    rows = rows.withColumn("group", F.regexp_extract("file", "/(lang=[^/]*/source=[^/]*)/", 1))
    counted = rows.groupBy("group", "file").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("group").orderBy("first")) - F.col("lines")
    counted = counted.select("group", "file", before.alias("before"))
    name = lambda part: F.nullif(F.regexp_extract("group", f"{part}=([^/]*)", 1), F.lit("__HIVE_DEFAULT_PARTITION__"))
    return rows.join(counted, ["group", "file"]).select(
        "doc_id", name("lang").alias("lang"), name("source").alias("source"), (F.col("number") + F.col("before")).alias("number")
    )


@query(f"{DOCS_SQL} WHERE lang = 'en'")
def src_split(spark, sf):
    return _digests(files.read_split_files(spark, sharded_documents(spark, sf), "train"))


@query(DOCS_SQL)
def src_evaluation(spark, sf):
    return _digests(locator.read_evaluation(spark, sharded_documents(spark, sf)))


@query(f"{DOCS_SQL} WHERE lang = 'fr'")
def src_columnar(spark, sf):
    directory = scratch_dir(spark, "columnar")
    docs = load(spark, sf, "documents")
    docs.filter(F.col("lang") == "fr").write.parquet(f"{directory}/test")
    docs.filter(F.col("lang") != "fr").write.parquet(f"{directory}/train")
    rows = locator.read_dataset(spark, f"hf:{directory}:test")
    return rows.select("doc_id", F.md5("text").alias("digest"))


@query("SELECT doc_id, lang, source, n_chars, md5(text) AS digest FROM documents")
def src_arrow(spark, sf):
    """A dataset of two Arrow splits with a description, read in ranges of its files."""
    directory = scratch_dir(spark, "arrow")
    docs = load(spark, sf, "documents")
    french = F.col("lang").eqNullSafe("fr")
    arrow.write_arrow_splits({"test": docs.filter(french), "train": docs.filter(~french)}, directory)
    test = locator.read_dataset(spark, f"hf:{directory}:test")
    train = arrow.read_arrow(spark, directory, "train", ["text", "doc_id", "n_chars", "source", "lang"], 1 << 20)
    rows = test.unionByName(train)
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))


@query(f"{DOCS_SQL} WHERE lang <> 'de'")
def src_named(spark, sf):
    docs = load(spark, sf, "documents")
    split = F.when(F.col("lang") == "de", "test").otherwise("train")
    docs.withColumn("split", split).createOrReplaceTempView("named_documents")
    rows = locator.read_named(spark, "named_documents")
    return rows.select("doc_id", F.md5("text").alias("digest"))


@query("SELECT lang AS dataset, COUNT(DISTINCT source) AS files FROM documents GROUP BY lang")
def dataset_catalog(spark, sf):
    root = scratch_dir(spark, "catalog")
    docs = document_json(spark, sf).select("lang", "source", "line")
    docs.repartition("lang", "source").write.partitionBy("lang", "source").json(root)
    found = catalog.dataset_catalog(spark, root)
    return found.withColumn("dataset", F.regexp_replace("dataset", "^lang=", ""))


@query(
    "SELECT CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS split, COUNT(*) AS rows FROM documents GROUP BY 1"
)
def split_catalog(spark, sf):
    return catalog.split_catalog(spark, sharded_documents(spark, sf))


@query(f"WITH {PAIRS_SQL} SELECT run_id, example_id, md5(prediction) AS digest FROM preds")
def scores_csv(spark, sf):
    path = scratch_dir(spark, "scores")
    sinks.write_scores(predictions(spark, sf), path)
    rows = sinks.read_scores(spark, path, "example_id long, run_id string, prediction string")
    return rows.select("run_id", "example_id", F.md5(F.coalesce("prediction", F.lit(""))).alias("digest"))


@query(
    """SELECT user_id AS run_id, 'base-7b' AS model, 'a,b' AS adapters, 'chat' AS dataset, 'test' AS shard,
      COUNT(*) AS num_examples, round(SUM(CAST(value AS DECIMAL(18,2)))::DOUBLE, 2) AS overall_score,
      CASE WHEN SUM(CAST(value AS DECIMAL(18,2))) >= 90 THEN 'A+ (Excellent)' ELSE 'other' END AS quality_grade,
      CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) * 0.5::DOUBLE AS part
    FROM events GROUP BY user_id"""
)
def summary_json(spark, sf):
    """Summaries with all their fields, written as JSON and read back by the sink's schema."""
    path = scratch_dir(spark, "summaries")
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    rows = load(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.count(F.lit(1)).alias("num_examples"), total.alias("overall_score")
    )
    part = F.struct(F.col("overall_score").alias("score"), F.lit(0.5).alias("weight"),
                    (F.col("overall_score") * 0.5).alias("contribution"))
    rows = rows.withColumn("score_breakdown", F.create_map(F.lit("BERTScore"), part))
    rows = rows.withColumn("quality_grade", F.when(F.col("overall_score") >= 90, "A+ (Excellent)").otherwise("other"))
    sinks.write_summary(identify_runs(rows, "base-7b", ["a", "b"], "chat", "test"), path)
    return sinks.read_summaries(spark, path).select(
        F.col("run_id").cast("long").alias("run_id"), "model", F.array_join("adapters", ",").alias("adapters"),
        "dataset", "shard", "num_examples", F.round("overall_score", 2).alias("overall_score"), "quality_grade",
        F.col("score_breakdown")["BERTScore"]["contribution"].alias("part"),
    )


@query("SELECT lang AS split, COUNT(*) AS rows FROM documents GROUP BY lang")
def split_catalog_described(spark, sf):
    """Sizes of the splits from the dataset's own description file."""
    directory = scratch_dir(spark, "described")
    counts = load(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("num_examples"))
    splits = F.map_from_entries(F.collect_list(F.struct("lang", F.struct("num_examples"))))
    info = counts.agg(F.to_json(F.create_map(F.lit("default"), F.struct(splits.alias("splits")))).alias("value"))
    info.coalesce(1).write.text(f"{directory}/raw")
    move_one(spark, f"{directory}/raw/part-*", f"{directory}/dataset_infos.json")
    return catalog.split_catalog(spark, directory)


@query("SELECT lang AS split, COUNT(*) AS rows FROM documents GROUP BY lang")
def split_catalog_columnar(spark, sf):
    """Sizes of the splits of a dataset with a Parquet directory per split."""
    directory = scratch_dir(spark, "columnar-splits")
    docs = load(spark, sf, "documents").select("lang", "doc_id")
    for split in ("en", "fr", "de", "es"):
        docs.filter(F.col("lang") == split).write.parquet(f"{directory}/{split}")
    return catalog.split_catalog(spark, directory)


def _arriving(spark, sf):
    """Folder of record lines in four files, or in as many as their length asks for."""
    directory = scratch_dir(spark, "arriving")
    size = load(spark, sf, "documents").agg(F.sum("n_chars")).first()[0] or 0
    record_lines(spark, sf).select("line").repartition(max(4, -(-size // ARRIVING))).write.text(directory)
    return directory


@query(f"WITH {VALID_SQL} SELECT md5(text) AS digest FROM valid WHERE shape IN (0, 1, 2, 3, 4, 6)")
def stream_prepare(spark, sf):
    source, out = _arriving(spark, sf), scratch_dir(spark, "prepared")
    rows = prepare_stream(stream_lines(spark, source, 2), 1536, permissive=True).select(F.md5("text").alias("digest"))
    _drain(spark, rows, out)
    return spark.read.parquet(out)


@query(
    f"""WITH {VALID_SQL}, judged AS (
      SELECT CASE WHEN shape = 9 THEN 'malformed' WHEN shape NOT IN (0, 1, 2, 3, 4, 6) THEN 'no_known_shape'
                  WHEN length(trim(r.text, {WS})) = 0 THEN 'empty' ELSE 'example' END AS kind,
             CASE WHEN shape IN (0, 1, 2, 3, 4, 6) AND length(trim(r.text, {WS})) > 0 THEN md5(r.text) END AS digest
      FROM d LEFT JOIN rendered r USING (doc_id, shape)),
    totals AS (SELECT count(*) AS n, count(*) FILTER (kind IN ('example', 'empty')) AS valid,
                      count(*) FILTER (kind = 'empty') AS blank FROM judged)
    SELECT kind, digest, count(*) AS n FROM judged GROUP BY ALL
    UNION ALL SELECT 'total_rows', NULL, n FROM totals
    UNION ALL SELECT 'valid_rows', NULL, valid FROM totals
    UNION ALL SELECT 'skipped_rows', NULL, n - valid FROM totals
    UNION ALL SELECT 'empty_rows', NULL, blank FROM totals"""
)
def stream_rejects(spark, sf):
    """Examples, rejects by reason and counts of arriving lines, over several triggers."""
    source, out = _arriving(spark, sf), scratch_dir(spark, "ingested")
    progress = scratch_dir(spark, "progress")
    lines = stream_lines(spark, source, 2)
    arriving.stream_ingest(lines, out, progress, 1536, permissive=True, availableNow=True).awaitTermination()
    good = arriving.examples(spark, out).select(F.lit("example").alias("kind"), F.md5("text").alias("digest"))
    none = F.lit(None).cast("string").alias("digest")
    bad = arriving.rejects(spark, out).select(F.col("reason").alias("kind"), none)
    rows = good.unionByName(bad).groupBy("kind", "digest").agg(F.count(F.lit(1)).alias("n"))
    totals = arriving.counts(spark, out).unpivot([], ["total_rows", "valid_rows", "skipped_rows", "empty_rows"], "kind", "n")
    return rows.unionByName(totals.select("kind", none, "n"))


@query(EARLY_STOP_SQL)
def stream_early_stop(spark, sf):
    """The runs' logs arrive in four parts of their steps; each run of the stream goes on from the last one's state."""
    source, out, progress = (scratch_dir(spark, x) for x in ("metrics", "stops", "progress"))
    table = metric_rows(spark, sf)
    bounds = table.agg(F.percentile_approx("step", [0.25, 0.5, 0.75])).first()[0]
    part = sum((F.when(F.col("step") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    for number in range(len(bounds) + 1):
        table.filter(part == number).write.mode("append").parquet(source)
        metrics = spark.readStream.schema(table.schema).parquet(source)
        changes = stopping.stream_early_stop(metrics, "eval_loss", 3, 0.001)
        stopping.keep_current(changes, out, progress, availableNow=True).awaitTermination()
    return stopping.current(spark, out, "run").select("run", "evaluations", "stop_step")


def _drain(spark, rows, out, progress=None):
    running = (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", progress or scratch_dir(spark, "progress"))
        .trigger(availableNow=True)
        .start(out)
    )
    running.awaitTermination()


@query(f"WITH {HISTORY_SQL} SELECT conv_id, turn, prompt FROM prompts")
def stream_history(spark, sf):
    """All messages, in files of any order of turns."""
    source, out = scratch_dir(spark, "messages"), scratch_dir(spark, "prompts")
    load(spark, sf, "conversations").repartition(4, "text").write.parquet(source)
    _drain(spark, history_stream(stream_messages(spark, source, 2), idle=None), out)
    rows = spark.read.parquet(out)
    return rows.filter("kind = 'prompt'").drop("kind")


@query(
    f"""WITH given AS (SELECT conv_id, max(turn) AS n FROM conversations GROUP BY conv_id),
    heard AS (SELECT c.* FROM conversations c JOIN given USING (conv_id) WHERE c.conv_id % 3 <> 1 OR turn <> 2 OR n < 5),
    {HISTORY_SQL.replace("FROM conversations", "FROM heard AS conversations")}
    SELECT conv_id, turn, 'prompt' AS kind, prompt FROM prompts
    UNION ALL SELECT conv_id, turn, 'repeated', NULL FROM conversations WHERE conv_id % 3 = 0 AND turn < 2
    UNION ALL SELECT c.conv_id, turn, 'late', NULL FROM conversations c JOIN given USING (conv_id)
      WHERE c.conv_id % 3 = 1 AND turn = 2 AND n >= 5"""
)
def stream_history_late(spark, sf):
    """A window of three turns: in a third of the conversations turn 2 comes after turn 5, in another third turns come twice.

    The second run goes on from the first one's state. A late message is a row of
    its own, as is a repeated one.
    """
    source, out, progress = (scratch_dir(spark, x) for x in ("messages", "prompts", "progress"))
    table = load(spark, sf, "conversations")
    # Conversations that end before turn 5 have no message that gives the gap up: they come whole.
    known = table.join(table.groupBy("conv_id").agg(F.max("turn").alias("n")), "conv_id")
    held = (F.col("conv_id") % 3 == 1) & (F.col("turn") == 2) & (F.col("n") >= 5)
    again = (F.col("conv_id") % 3 == 0) & (F.col("turn") < 2)
    for part in (~held, held | again):
        known.filter(part).select(*table.columns).write.mode("append").parquet(source)
        _drain(spark, history_stream(stream_messages(spark, source, 1000), idle=None, window=3), out, progress)
    return spark.read.parquet(out).select("conv_id", "turn", "kind", "prompt")


@query(f"WITH {LOG_SQL} SELECT DISTINCT run, ts, step, metric, value FROM log_metrics")
def stream_metrics(spark, sf):
    source, out = scratch_dir(spark, "logs"), scratch_dir(spark, "metrics")
    named = log_lines(spark, sf).select(F.concat_ws(" ", "run", "line").alias("value"))
    # A rotated copy repeats every line of the log.
    named.write.text(source)
    named.write.mode("append").text(source)
    lines = spark.readStream.text(source).select(
        F.substring_index("value", " ", 1).alias("run"),
        F.regexp_replace("value", "^[^ ]* ", "").alias("line"),
    )
    _drain(spark, metrics_stream(lines, "30 days").drop("level"), out)
    return spark.read.parquet(out).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
