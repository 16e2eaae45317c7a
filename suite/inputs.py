"""Inputs of the registered queries, all derived from the given tables.

Every row and the whole of every text is used. Documents become records of ten
kinds, the last digit of their source saying which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions import fixed
from corvane.functions.text import halves
from corvane.operators.conversations import turn_pairs
from corvane.operators.ingest import with_record
from corvane.session import scratch_dir
from corvane.sources.files import files_below, glob_paths, spread

WS = "'" + fixed.WHITESPACE + "'"
WORDS = "'" + fixed.WORD_PATTERN + "'"


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    # The texts come as one file of one row group: a single task's work.
    return spread(df) if name == "documents" and len(df.inputFiles()) == 1 else df


# --- Raw records --------------------------------------------------------------


def _broken(doc: Column, head: Column) -> Column:
    """A line that is not one object: cut short, or whole with something after it."""
    whole = F.concat(head, F.lit('"}'))
    line = head
    for i, after in enumerate(["]", "}", ",", " garbage", '] , [{"text":"b"}', "] x", '"', ',{"text":"b"}']):
        line = F.when(doc % 9 == i, F.concat(whole, F.lit(after))).otherwise(line)
    return line


def record_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, line)``: each document as a JSON line of one of ten kinds."""
    docs = load(spark, sf, "documents")
    half = halves(F.col("text"))
    head, tail = half["prompt"], half["reference"]
    text, source, lang = F.col("text"), F.col("source"), F.col("lang")

    def obj(**fields: Column) -> Column:
        return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    blank = F.when(lang == "es", F.lit(" \n\t ")).otherwise(text)
    kinds = [
        obj(instruction=source, input=text, output=lang),
        obj(instruction=text, response=source),
        obj(prompt=head, completion=tail),
        obj(input=head, output=tail),
        obj(messages=F.array(message("system", source), message("user", head), message("assistant", tail))),
        obj(conversation=F.array(head, tail)),
        obj(text=blank),
        obj(question=head, answer=tail),
        obj(title=source, body=text),
        _broken(F.col("doc_id"), F.concat(F.lit('{"text": "'), source)),
    ]
    shape = F.substring("source", -1, 1).cast("int")
    line = F.when(shape == 0, kinds[0])
    for i, kind in enumerate(kinds[1:], 1):
        line = line.when(shape == i, kind)
    return docs.select("doc_id", line.alias("line"))


def records(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, record)`` of every line that parses."""
    tagged = with_record(record_lines(spark, sf))
    return tagged.filter(F.col("record").isNotNull()).select("doc_id", "record")


RECORDS_SQL = """
d AS (
  SELECT doc_id, lang, source, text, CAST(right(source, 1) AS INTEGER) AS shape,
         substr(text, 1, length(text) // 2) AS h,
         substr(text, length(text) // 2 + 1) AS t,
         CASE WHEN lang = 'es' THEN E' \\n\\t ' ELSE text END AS b
  FROM documents
)"""

RENDERED_SQL = (
    RECORDS_SQL
    + f""",
rendered AS (
  SELECT doc_id, shape, CASE shape
    WHEN 0 THEN E'### Instruction:\\n' || source || E'\\n\\n### Input:\\n' || text || E'\\n\\n### Response:\\n' || lang
    WHEN 1 THEN E'### Instruction:\\n' || text || E'\\n'
    WHEN 2 THEN E'### Prompt:\\n' || h || E'\\n\\n### Response:\\n' || t
    WHEN 3 THEN E'### Input:\\n' || h || E'\\n\\n### Output:\\n' || t
    WHEN 4 THEN trim(E'### System:\\n' || source || E'\\n\\n### User:\\n' || h || E'\\n\\n### Assistant:\\n' || t, {WS})
    WHEN 5 THEN E'### Turn 1:\\n' || h || E'\\n\\n### Turn 2:\\n' || t
    WHEN 6 THEN b
    WHEN 7 THEN 'question:' || h || ' answer:' || t
    WHEN 8 THEN 'title:' || source || ' body:' || text
  END AS text
  FROM d WHERE shape <> 9
)"""
)

# --- Dialogues and predictions ------------------------------------------------


def dialog_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``(example_id, prompt, reference)`` of every answered user turn."""
    pairs = turn_pairs(load(spark, sf, "conversations"))
    return pairs.select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("example_id"),
        F.col("user").alias("prompt"),
        F.col("assistant").alias("reference"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs: ``half`` answers half of the reference, ``echo`` the prompt."""
    pairs = dialog_pairs(spark, sf)
    runs = F.array(
        F.struct(F.lit("half").alias("run_id"), halves(F.col("reference"))["prompt"].alias("prediction")),
        F.struct(F.lit("echo").alias("run_id"), F.col("prompt").alias("prediction")),
    )
    return pairs.select("example_id", F.inline(runs))


PAIRS_SQL = f"""
turns AS (
  SELECT conv_id, turn, role, text,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
  FROM conversations
),
users AS (
  SELECT conv_id, turn, trim(text, {WS}) AS u,
         CASE WHEN next_role = 'assistant' THEN trim(next_text, {WS}) END AS a
  FROM turns WHERE role = 'user' AND length(trim(text, {WS})) > 0
),
pairs AS (
  SELECT conv_id * 100000 + turn AS example_id, conv_id, turn, u AS prompt, a AS reference
  FROM users WHERE a IS NOT NULL
),
preds AS (
  SELECT 'half' AS run_id, example_id, substr(reference, 1, length(reference) // 2) AS prediction FROM pairs
  UNION ALL
  SELECT 'echo', example_id, prompt FROM pairs
)"""

# --- Events as metrics, files, commands ---------------------------------------


def metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``(run, step, metric, value)``: a run per user, some without a name, a step per event."""
    evaluation = F.col("event_type").isin("view", "error")
    return load(spark, sf, "events").select(
        F.when(F.col("user_id") % 40 != 7, F.concat(F.lit("u"), "user_id")).alias("run"),
        F.col("event_id").alias("step"),
        F.when(evaluation, "eval_loss").otherwise("loss").alias("metric"),
        "value",
    )


METRICS_SQL = """
metrics AS (
  SELECT CASE WHEN user_id % 40 <> 7 THEN 'u' || user_id END AS run, event_id AS step,
         CASE WHEN event_type IN ('view', 'error') THEN 'eval_loss' ELSE 'loss' END AS metric,
         value
  FROM events
)"""


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """One row of run metrics per user, from exact sums of the event values."""

    def mean(kind: str) -> Column:
        of = F.when(F.col("event_type") == kind, F.col("value").cast("decimal(18,2)"))
        return F.sum(of).cast("double") / F.count(of)

    high = F.count_if(F.col("value") >= 30)
    return (
        load(spark, sf, "events")
        .groupBy(F.col("user_id").alias("run_id"))
        .agg(
            (mean("click") + 50).alias("bert_score"),
            mean("view").alias("rouge_score"),
            (100 - F.least(F.max("value") - F.min("value"), F.lit(100.0))).alias("consistency"),
            (100.0 * high / F.count(F.lit(1))).alias("high_quality_pct"),
            (mean("purchase") * 5).alias("perplexity"),
            (mean("signup") + 40).alias("mcq"),
        )
    )


RUN_METRICS_SQL = """
run_metrics AS (
  SELECT user_id AS run_id,
    CAST(SUM(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE)
      / COUNT(CASE WHEN event_type = 'click' THEN 1 END) + 50 AS bert_score,
    CAST(SUM(CASE WHEN event_type = 'view' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE)
      / COUNT(CASE WHEN event_type = 'view' THEN 1 END) AS rouge_score,
    100 - LEAST(MAX(value) - MIN(value), 100.0) AS consistency,
    100.0::DOUBLE * COUNT(CASE WHEN value >= 30 THEN 1 END) / COUNT(*) AS high_quality_pct,
    CAST(SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE)
      / COUNT(CASE WHEN event_type = 'purchase' THEN 1 END) * 5 AS perplexity,
    CAST(SUM(CASE WHEN event_type = 'signup' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE)
      / COUNT(CASE WHEN event_type = 'signup' THEN 1 END) + 40 AS mcq
  FROM events GROUP BY user_id
)"""


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """``(path, length)``: a file per event in its user's adapter directory."""
    kind = F.col("event_type")
    file = (
        F.when(kind == "click", "adapter_config.json")
        .when(kind == "view", "adapter_model.safetensors")
        .when(kind == "purchase", "adapter_model.bin")
        .when(kind == "error", "README.md")
        .otherwise("tokenizer.json")
    )
    place = F.when(F.col("value") > 60, F.lit("")).otherwise(
        F.concat(F.lit("checkpoint-"), F.floor(F.col("event_id") / 1500).cast("string"), F.lit("/"))
    )
    return load(spark, sf, "events").select(
        F.concat(F.lit("adapters/a"), F.col("user_id").cast("string"), F.lit("/"), place, file).alias("path"),
        F.floor(F.col("value") * 100).cast("long").alias("length"),
    )


LISTING_SQL = """
files AS (
  SELECT 'a' || user_id AS adapter,
    CASE WHEN value > 60 THEN NULL ELSE event_id // 1500 END AS number,
    CASE event_type WHEN 'click' THEN 'adapter_config.json' WHEN 'view' THEN 'adapter_model.safetensors'
      WHEN 'purchase' THEN 'adapter_model.bin' WHEN 'error' THEN 'README.md' ELSE 'tokenizer.json' END AS file,
    CAST(floor(value * 100) AS BIGINT) AS length
  FROM events
),
validity AS (
  SELECT adapter, number, CASE WHEN number IS NULL THEN NULL ELSE 'checkpoint-' || number END AS checkpoint,
    bool_or(file = 'adapter_config.json') AS has_config,
    bool_or(file IN ('adapter_model.safetensors', 'adapter_model.bin')) AS has_model,
    CAST(SUM(length) AS BIGINT) AS bytes
  FROM files GROUP BY adapter, number
),
v AS (SELECT *, has_config AND has_model AS valid FROM validity),
per_adapter AS (
  SELECT adapter,
    coalesce(bool_or(number IS NULL AND has_config), false) AS root_config,
    coalesce(bool_or(number IS NULL AND valid), false) AS root_valid,
    COUNT(number) AS checkpoints,
    max_by(checkpoint, number) FILTER (WHERE number IS NOT NULL) AS latest,
    max_by(has_config, number) FILTER (WHERE number IS NOT NULL) AS latest_config,
    max_by(valid, number) FILTER (WHERE number IS NOT NULL) AS latest_ok,
    max_by(checkpoint, number) FILTER (WHERE number IS NOT NULL AND valid) AS latest_valid
  FROM v GROUP BY adapter
)"""


def commands(spark: SparkSession, sf: str) -> DataFrame:
    """``(conv_id, turn, text)``: what a user types, a session per user."""
    kind, value = F.col("event_type"), F.col("value")
    text = (
        F.when((kind == "error") & (value > 40), " Clear ")
        .when((kind == "signup") & (value > 30), "context")
        .when((kind == "purchase") & (value > 110), "QUIT")
        .when((kind == "view") & (value < 2), " \n")
        .when((kind == "click") & (value < 2), "save")
        .otherwise(F.col("props"))
    )
    return load(spark, sf, "events").select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), text.alias("text")
    )


COMMANDS_SQL = """
commands AS (
  SELECT user_id AS conv_id, event_id AS turn,
    CASE WHEN event_type = 'error' AND value > 40 THEN 'clear'
         WHEN event_type = 'signup' AND value > 30 THEN 'context'
         WHEN event_type = 'purchase' AND value > 110 THEN 'quit'
         WHEN event_type = 'view' AND value < 2 THEN ''
         WHEN event_type = 'click' AND value < 2 THEN 'save'
         ELSE props END AS text
  FROM events
)"""


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``(run, line)``: a training log line per event."""
    value = F.format_string("%.4f", F.col("value"))
    epoch = F.format_string("%.4f", F.col("event_id") / 1000)
    prefix = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" | INFO     | __main__:report:7 - ")
    )
    name = F.when(F.col("event_type").isin("view", "error"), "eval_loss").otherwise("loss")
    step = F.col("event_id").cast("string")
    report = F.concat(prefix, F.lit("Step "), step, F.lit(" | "), name, F.lit(": "), value, F.lit(", epoch: "), epoch)
    line = F.when(F.col("event_type") == "signup", F.concat(prefix, F.lit("Evaluation at step "), step))
    return load(spark, sf, "events").select(
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run"), line.otherwise(report).alias("line")
    )


LOG_SQL = """
logged AS (
  SELECT 'run' || user_id AS run, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id AS step,
    CASE WHEN event_type IN ('view', 'error') THEN 'eval_loss' ELSE 'loss' END AS name, value,
    event_id / 1000 AS epoch
  FROM events WHERE event_type <> 'signup'
),
log_metrics AS (
  SELECT run, ts, step, name AS metric, value FROM logged
  UNION ALL SELECT run, ts, step, 'epoch', epoch FROM logged
)"""

# --- Files --------------------------------------------------------------------


def document_json(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, lang, source, line)``: every document as ``{"doc_id", "text"}``."""
    docs = load(spark, sf, "documents")
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    return docs.select("doc_id", "lang", "source", line.alias("line"))


def write_shards(df: DataFrame, directory: str, split: str, suffix: str) -> None:
    """Write ``line`` as shards ``split-NNNNN-of-NNNNN`` + suffix."""
    spark = df.sparkSession
    raw = f"{directory}/_written-{split}"
    writer = df.select("line").write
    if suffix.endswith(".gz"):
        writer = writer.option("compression", "gzip")
    writer.text(raw)
    parts = glob_paths(spark, f"{raw}/part-*")
    for i, part in enumerate(parts):
        source = spark._jvm.org.apache.hadoop.fs.Path(part)
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/{split}-{i:05d}-of-{len(parts):05d}{suffix}")
        source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target)


def move_one(spark: SparkSession, pattern: str, target: str) -> None:
    """Give the only file that matches another name."""
    (source,) = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in glob_paths(spark, pattern))
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    system.rename(source, spark._jvm.org.apache.hadoop.fs.Path(target))


def name_as_json(spark: SparkSession, directory: str) -> None:
    """Give the part files below a directory the suffix ``.json``."""
    for part in files_below(spark, directory, "part-*.txt"):
        source = spark._jvm.org.apache.hadoop.fs.Path(part)
        target = spark._jvm.org.apache.hadoop.fs.Path(part.removesuffix(".txt") + ".json")
        source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target)


def sharded_documents(spark: SparkSession, sf: str) -> str:
    """Documents as shards: ``train`` has the English ones, ``test`` the others."""
    directory = scratch_dir(spark, "shards")
    docs = document_json(spark, sf)
    write_shards(docs.filter(F.col("lang") == "en"), directory, "train", ".jsonl.gz")
    write_shards(docs.filter(F.col("lang") != "en"), directory, "test", ".jsonl")
    return directory
