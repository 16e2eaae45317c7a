"""Tokenization, vocabulary and encoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corvane.functions import fixed
from corvane.functions.text import word_tokens
from corvane.operators.once import once
from corvane.operators.top import most_frequent, ranked
from corvane.session import staged

# A vocabulary up to this size is looked up in place; what is beyond it by a join.
MAX_VOCAB = 1 << 18
SLOTS = 1 << 15


def tokenize(df: DataFrame, max_length: int | None, text: str = "text") -> DataFrame:
    """Add ``tokens`` (cut at ``max_length``), ``attention_mask`` and ``n_tokens``.

    ``n_tokens`` is the size before the cut. No padding happens here.
    """
    out = once(df, tokens=word_tokens(F.col(text)))
    out = out.withColumn("n_tokens", F.size("tokens"))
    if max_length is not None:
        out = out.withColumn("tokens", F.slice("tokens", 1, max_length))
    return out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("tokens")))


def fit_vocab(df: DataFrame, size: int, tokens: str = "tokens", min_count: int = 1) -> DataFrame:
    """The ``size`` most frequent tokens as ``(token, rows, token_id)``.

    Ids follow (count descending, token) and start after the pad and unknown
    ids. Counting combines on the map side, so frequent tokens do no harm. A
    vocabulary above ``MAX_VOCAB`` is ranked over many tasks.
    """
    counts = (
        df.select(F.explode(tokens).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") >= min_count)
    )
    if size > MAX_VOCAB:
        top = ranked(counts, "token_id", F.desc("rows"), "token").filter(F.col("token_id") <= size)
        return top.select("token", "rows", (F.col("token_id") + fixed.UNK_ID).cast("int").alias("token_id"))
    top = most_frequent(counts, size, "rows", "token")
    rank = F.row_number().over(Window.orderBy(F.desc("rows"), "token"))
    return top.withColumn("token_id", rank + fixed.UNK_ID)


def _lookup(vocab: DataFrame) -> DataFrame:
    """The vocabulary as one row: an array of ``SLOTS`` small maps, by token hash."""
    spark = vocab.sparkSession
    slot = F.pmod(F.xxhash64("token"), F.lit(SLOTS)).cast("int")
    filled = vocab.groupBy(slot.alias("slot")).agg(
        F.collect_list(F.struct("token", "token_id")).alias("entries")
    )
    slots = spark.range(0, SLOTS, 1, 1).select(F.col("id").cast("int").alias("slot"))
    rows = F.array_sort(F.collect_list(F.struct("slot", "entries")))
    maps = F.transform(rows, lambda r: F.map_from_entries(r["entries"]))
    return slots.join(filled, "slot", "left").agg(maps.alias("slots"))


def _in_place(df: DataFrame, vocab: DataFrame, tokens: str, out: str) -> DataFrame:
    """Add the tokens' ids, NULL outside ``vocab``, which is one scalar looked up inside each row."""

    def token_id(token):
        slot = F.pmod(F.xxhash64(token), F.lit(SLOTS)).cast("int")
        return F.get(F.col("_slots"), slot)[token]

    return df.withColumn("_slots", _lookup(vocab).scalar()).withColumn(out, F.transform(tokens, token_id)).drop("_slots")


def encode(df: DataFrame, vocab: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Add ``input_ids``; tokens outside the vocabulary get the unknown id.

    Counts the vocabulary first. Up to ``MAX_VOCAB`` tokens are one scalar value
    looked up inside each row: the texts are neither exploded nor shuffled. Of a
    larger vocabulary the ``MAX_VOCAB`` tokens with the lowest ids (the most
    frequent ones, as ``fit_vocab`` numbers them) are looked up so; a row's
    other tokens, each once, meet the rest of the vocabulary in a join.
    """
    known = vocab.select("token", "token_id")
    unknown = F.lit(fixed.UNK_ID)
    if known.limit(MAX_VOCAB + 1).count() <= MAX_VOCAB:
        found = _in_place(df, known, tokens, "input_ids")
        return found.withColumn("input_ids", F.transform("input_ids", lambda x: F.coalesce(x, unknown)))

    known = staged(known, "vocabulary")
    bound = known.orderBy("token_id").limit(MAX_VOCAB).agg(F.max("token_id")).scalar()
    near, rest = known.filter(F.col("token_id") <= bound), known.filter(F.col("token_id") > bound)
    # Stored, so that a row keeps its number whichever way it is read.
    rows = staged(_in_place(df, near, tokens, "_near").withColumn("_row", F.monotonically_increasing_id()), "encoded")
    missing = F.filter(F.col(tokens), lambda t, i: F.get("_near", i).isNull())
    asked = rows.select("_row", F.explode(F.array_distinct(missing)).alias("token")).filter(F.col("token").isNotNull())
    entries = F.map_from_entries(F.collect_list(F.struct("token", "token_id")))
    far = asked.join(rest, "token").groupBy("_row").agg(entries.alias("_far"))
    ids = F.transform(tokens, lambda t, i: F.coalesce(F.get("_near", i), F.col("_far")[t], unknown))
    return rows.join(far, "_row", "left").withColumn("input_ids", ids).drop("_row", "_near", "_far")


def map_texts(
    df: DataFrame,
    make_fn: Callable[[], Callable[[Sequence[str | None]], Sequence[Sequence]]],
    text: str,
    added: list[T.StructField],
    batch_size: int,
    keep_text: bool = True,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Add columns that a user function makes of one text column.

    ``make_fn`` runs once per task, so a model or tokenizer is loaded there and
    not per batch. The function gets lists of at most ``batch_size`` texts and
    returns a list per added column. All other columns stay in their Arrow
    batch, bit by bit; rows never leave their partition. A NULL text reaches
    the function as None. ``profile`` asks for executors of a kind for this stage.
    """
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, *added])
    kinds = [to_arrow_type(f.dataType) for f in added]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make_fn()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                made = fn(part.column(text).to_pylist())
                arrays = [part.column(n) for n in names]
                arrays += [pa.array(values, type=kind) for values, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return df.mapInArrow(run, schema, profile=profile)


def tokenize_with(
    df: DataFrame,
    make_encoder: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[int]]]],
    max_length: int | None,
    text: str = "text",
    batch_size: int = 1000,
) -> DataFrame:
    """Tokenize with a user encoder (texts -> id lists), cut at ``max_length``.

    Replaces the text by ``input_ids``, ``attention_mask`` and ``n_tokens``; a
    NULL text has none of them. The encoder does not see NULL texts.
    """
    ids = T.ArrayType(T.IntegerType())
    added = [
        T.StructField("input_ids", ids),
        T.StructField("attention_mask", ids),
        T.StructField("n_tokens", T.IntegerType()),
    ]

    def make_fn():
        encode_batch = make_encoder()

        def fn(texts: list[str | None]) -> list[list]:
            given = [t for t in texts if t is not None]
            made = iter([list(x) for x in encode_batch(given)] if given else [])
            all_ids = [None if t is None else next(made) for t in texts]
            cut = [None if x is None else x[:max_length] for x in all_ids]
            masks = [None if x is None else [1] * len(x) for x in cut]
            return [cut, masks, [None if x is None else len(x) for x in all_ids]]

        return fn

    return map_texts(df, make_fn, text, added, batch_size, keep_text=False)
