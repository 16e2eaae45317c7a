"""Mix sources to target weights by capped water-filling.

Every source gets a share of the words asked for in proportion to its weight,
but at most ``epochs`` times its own words; what a clamped source cannot give
is shared anew by weight until no source is above its cap. The documents of a
source are then repeated a whole number of times, and a seeded part of them
once more.

No row of the documents is shuffled: sizes are aggregated by source (and by
leading digits of a digest) with map-side partial sums, and each document
decides alone from one bound per source how often it is taken. The per-source
table is written out first, so that Spark broadcasts it by its true size or
joins it by sorting, with skewed keys split, when it is large.

Defined results. NULL text or a text without words: size 0, never more than
size 0 taken. NULL source: a source of its own, last in order. Rows that share
an id share the decision (a group of copies of one id is taken or left
together). NULL ids share one digest. An empty table gives no rows. Only the
named columns are read; others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.llm.common import count_words
from corvane.session import staged

DIGEST_BITS = 60  # 15 hexadecimal digits
STEP = 12  # bits per histogram: 4,096 groups a source


def digest_of(key: Column, seed: int) -> Column:
    """A number of 60 bits from seed and key, the same on every engine that has MD5."""
    text = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(text, 1, DIGEST_BITS // 4), 16, 10).cast("long")


def sized(
    docs: DataFrame, seed: int, id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """``doc_id, source, size, digest``: all that the mix has to know of a document."""
    return docs.select(
        F.col(id).alias("doc_id"),
        F.col(source).alias("source"),
        count_words(F.col(text)).alias("size"),
        digest_of(F.col(id), seed).alias("digest"),
    )


def weigh(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Add ``weight``: the given ones in turn, by source in code point order, NULL last."""
    # One row per source here, never per document.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.element_at(cycle, ((rank - 1) % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, share: float = 1.0, epochs: float = 3.0) -> DataFrame:
    """Add ``target`` to rows of ``source, source_size, weight``.

    In order of cap by weight the clamped sources come first. The level that
    would hold if exactly the earlier ones were clamped rises up to the true
    clamping point and falls after it, so the true level is its maximum.
    """
    cap = F.lit(float(epochs)) * F.col("source_size")
    order = Window.orderBy((cap / F.col("weight")), "source_size", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    asked = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (asked - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        sources.withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(everything))
        .withColumn("target", F.least(cap, F.col("_level") * F.col("weight")))
        .drop("_level")
    )


def _crossing(rows: DataFrame, digit: Column, carried: list[str]) -> DataFrame:
    """Per source, the digit whose documents cross what is still needed, and the need inside it."""
    sums = rows.groupBy("source", *carried, "need", digit.alias("digit")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("digit"))
    return (
        sums.withColumn("before", upto - F.col("words"))
        .filter((F.col("before") <= F.col("need")) & (F.col("need") < F.col("before") + F.col("words")))
        .select("source", *carried, "digit", (F.col("need") - F.col("before")).alias("need"))
    )


def _same_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, left["source"].eqNullSafe(right["_source"]), how).drop("_source")


def repetitions(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole repetitions, and the largest digest that gets one more.

    The bound is found from two histograms of leading digits and the few
    documents (one in 16 million) that share both; a document is in when more
    than half of it fits in what the source still needs.
    """
    per = targets.withColumn(
        "whole",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
    ).withColumn("need", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))

    high, middle = DIGEST_BITS - STEP, DIGEST_BITS - 2 * STEP
    first = F.shiftright("digest", high)
    second = F.shiftright("digest", middle) % (1 << STEP)
    asked = _same_source(rows, per.select("source", "need"))
    spot1 = _crossing(asked, first, []).withColumnRenamed("digit", "head")
    inside = _same_source(rows, spot1).filter(first == F.col("head"))
    spot2 = _crossing(inside, second, ["head"]).withColumnRenamed("digit", "next")
    last = _same_source(rows, spot2).filter((first == F.col("head")) & (second == F.col("next")))
    by_digest = last.groupBy("source", "head", "next", "need", "digest").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("digest"))
    taken = by_digest.withColumn("middle", upto - F.col("words") / 2)
    bound = taken.groupBy("source").agg(
        # Everything below the shared digits is in, even when none of those that share them is.
        F.max(F.when(F.col("middle") <= F.col("need"), F.col("digest"))).alias("inner"),
        (F.shiftleft(F.first("head"), high) + F.shiftleft(F.first("next"), middle) - 1).alias("below"),
    )
    bound = bound.select("source", F.coalesce("inner", "below").alias("bound"))
    joined = _same_source(per, bound, "left")
    none, every = F.lit(-1).cast("long"), F.lit((1 << DIGEST_BITS) - 1).cast("long")
    settled = F.when(F.col("need") <= 0, none).when(F.col("need") >= F.col("source_size"), every)
    return joined.withColumn("bound", settled.otherwise(F.col("bound"))).drop("need")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    share: float = 1.0,
    epochs: float = 3.0,
    seed: int = 42,
    **columns: str,
) -> DataFrame:
    """How often every document is taken.

    Returns ``doc_id, source, size, source_size, target, times, taken``;
    ``share`` is the words of the mix as a part of all words.
    """
    rows = staged(sized(docs, seed, **columns), "mix-sizes")
    per = staged(plan(rows, weights, share, epochs), "mix-sources")
    return _times(_same_source(rows, per)).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "times",
        (F.col("size") * F.col("times")).alias("taken"),
    )


def plan(rows: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """One row per source: its size, weight, target, whole repetitions and bound."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = staged(water_fill(weigh(sources, weights), share, epochs), "mix-targets")
    return repetitions(rows, targets)


def _times(joined: DataFrame) -> DataFrame:
    extra = F.coalesce((F.col("digest") <= F.col("bound")).cast("long"), F.lit(0))
    return joined.withColumn("times", F.col("whole") + extra)


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    share: float = 1.0,
    epochs: float = 3.0,
    seed: int = 42,
    **columns: str,
) -> DataFrame:
    """The documents of the mix: every row as often as it is taken, all columns as they are."""
    rows = staged(sized(docs, seed, **columns), "mix-sizes")
    per = staged(plan(rows, weights, share, epochs), "mix-sources")
    id, source = columns.get("id", "doc_id"), columns.get("source", "source")
    whole = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(source).alias("source"),
        digest_of(F.col(id), seed).alias("digest"),
    )
    repeated = _times(_same_source(whole, per)).filter(F.col("times") > 0)
    return repeated.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
