"""Exact seeded samples and splits without sorting or moving the data.

Every row gets a digest of the seed and its key. The ``k``-th smallest digest
is found from histograms (of the first digits, then of the next digits inside
the one bucket that holds it), each a map-side combined count with a bounded
number of groups. The sample is then a plain filter against that one value.
Keys are expected to be unique; rows that share a key stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions.text import seeded_hash
from corvane.operators.joins import join_same
from corvane.operators.top import ranked

RANKED = 1000  # rows of a group up to which Spark limits ranks before a shuffle
DIGITS = 3  # hexadecimal digits per histogram: 4,096 groups


def _place(counts: DataFrame, group: str, rank: Column) -> DataFrame:
    """The one group that holds the row of the given rank, with what is before it."""
    upto = F.sum("rows").over(Window.orderBy(group))
    return (
        counts.withColumn("upto", upto)
        .filter((F.col("upto") >= rank) & (F.col("upto") - F.col("rows") < rank))
        .select(F.col(group), (rank - (F.col("upto") - F.col("rows"))).alias("rank"))
    )


def _digest_of_rank(hashed: DataFrame, rank: Column) -> DataFrame:
    """One row, one column: the digest of the given (1-based) rank.

    ``rank`` may use the column ``total`` (row count). No row results when the
    rank is 0 or above the count.
    """
    first = F.substring("digest", 1, DIGITS)
    second = F.substring("digest", 1 + DIGITS, DIGITS)

    level1 = hashed.groupBy(first.alias("head")).agg(F.count(F.lit(1)).alias("rows"))
    level1 = level1.withColumn("total", F.sum("rows").over(Window.partitionBy()))
    spot1 = _place(level1, "head", rank)

    # One row by construction, so the broadcast is bounded.
    inside = hashed.withColumn("head", first).join(F.broadcast(spot1), "head")
    level2 = inside.groupBy(second.alias("next"), "rank").agg(F.count(F.lit(1)).alias("rows"))
    spot2 = _place(level2.withColumnRenamed("rank", "rank1"), "next", F.col("rank1"))
    rank2 = spot2.withColumnRenamed("rank", "rank2")

    # Some 1/16M of the distinct digests are left: order those by counts.
    last = (
        inside.drop("rank")
        .withColumn("next", second)
        .join(F.broadcast(rank2), "next")
        .groupBy("digest", "rank2")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    spot3 = _place(last, "digest", F.col("rank2"))
    return spot3.select("digest")


def _hashed(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.select(seeded_hash(F.col(key), seed).alias("digest"))


def head_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """First ``n`` rows in key order, for unique keys without NULLs.

    Sorting for a limit makes every partition send ``n`` rows to one task; above
    ``RANKED`` rows the key of rank ``n`` is found over ranges of the keys first,
    and the rest is a filter and a sort by ranges.
    """
    if n <= RANKED:
        return df.orderBy(key).limit(n)
    bound = ranked(df.select(key), "_rank", key).filter(F.col("_rank") == n).agg(F.max(key)).scalar()
    return df.filter(F.coalesce(F.col(key) <= bound, F.lit(True))).orderBy(key)


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows drawn without replacement; all rows when there are fewer."""
    if n <= 0:
        return df.limit(0)
    rank = F.least(F.lit(n).cast("long"), F.col("total"))
    bound = _digest_of_rank(_hashed(df, key, seed), rank).scalar()
    return df.filter(seeded_hash(F.col(key), seed) <= bound)


def _place_by(counts: DataFrame, by: list[str], group: str) -> DataFrame:
    """Per group of ``by``, the one place that holds the row of rank ``rank``, and its rank there."""
    upto = F.sum("rows").over(Window.partitionBy(*by).orderBy(group))
    before = counts.withColumn("before", upto - F.col("rows"))
    here = (F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("rows"))
    return before.filter(here).select(*by, group, (F.col("rank") - F.col("before")).alias("rank"))


def _bounds_by(hashed: DataFrame, by: list[str], n: int) -> DataFrame:
    """``by..., bound``: the digest of rank ``n`` in every group that has so many rows."""
    first, second = F.substring("digest", 1, DIGITS), F.substring("digest", 1 + DIGITS, DIGITS)
    rows = F.count(F.lit(1)).alias("rows")
    level1 = hashed.groupBy(*by, first.alias("head")).agg(rows).withColumn("rank", F.lit(n).cast("long"))
    spot1 = _place_by(level1, by, "head")
    inside = join_same(hashed.withColumn("head", first), spot1, [*by, "head"])
    level2 = inside.groupBy(*by, "head", "rank", second.alias("next")).agg(rows)
    spot2 = _place_by(level2, [*by, "head"], "next")
    last = join_same(inside.drop("rank").withColumn("next", second), spot2, [*by, "head", "next"])
    level3 = last.groupBy(*by, "head", "next", "rank", "digest").agg(rows)
    return _place_by(level3, [*by, "head", "next"], "digest").select(*by, F.col("digest").alias("bound"))


def sample_n_by(df: DataFrame, by: list[str], key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows of every group (all of a smaller one).

    Up to 1,000 Spark ranks the rows and applies the limit before the shuffle as
    well; beyond that a bound per group comes from histograms of the digests, as
    in ``sample_n``. Either way no group, however large, meets in one task, and
    the same rows are drawn.
    """
    digest = seeded_hash(F.col(key), seed)
    if n <= RANKED:
        placed = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(digest)))
        return placed.filter(F.col("_rank") <= n).drop("_rank")
    bounds = _bounds_by(df.select(*by, digest.alias("digest")), by, n)
    kept = join_same(df, bounds, by, "left")
    return kept.filter(F.col("bound").isNull() | (digest <= F.col("bound"))).drop("bound")


def train_eval_split(
    df: DataFrame, key: str, ratio: float, seed: int, exact: bool = True
) -> DataFrame:
    """Add ``split``: ``eval`` for ``ceil(ratio * n)`` rows, ``train`` for the rest.

    With ``exact=False`` each row decides alone (one pass, sizes approximate).
    """
    digest = seeded_hash(F.col(key), seed)
    if exact:
        rank = F.ceil(F.lit(float(ratio)) * F.col("total"))
        bound = _digest_of_rank(_hashed(df, key, seed), rank).scalar()
        chosen = F.coalesce(digest <= bound, F.lit(False))
    else:
        chosen = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < int(ratio * 2**32)
    return df.withColumn("split", F.when(chosen, "eval").otherwise("train"))


def split_report(df: DataFrame, split: str = "split", tokens_per_example: int = 1000) -> DataFrame:
    """Rows, share in percent and estimated million tokens of every split."""
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("examples"))
    total = F.sum("examples").over(Window.partitionBy())
    return counts.select(
        split,
        "examples",
        (100.0 * F.col("examples") / total).alias("percent"),
        (F.col("examples") * tokens_per_example / 1e6).alias("est_tokens_m"),
    )
