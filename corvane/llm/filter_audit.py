"""What each filter of a chain removes, in every order of the chain.

Every document gets a mask of the filters that it fails. Documents with one
mask fare alike in any order, so a part of the corpus is at most 32 weighted
masks, whatever its size. In the min-plus algebra a mask is a row with 0 where
its filter fails and infinity elsewhere, an order is a row with every filter's
position in it (the inverse permutation), and their product over the minimum is
the step at which the mask's documents go. That step says where a mask's weight
is scattered to: what a step removes, what remains, which failures came too
late because an earlier filter had the document already.

Copies are found without sending the copies of one text to one task: the least
id of every text comes from a combined aggregate, and a document asks for
itself, by its own id, among those firsts.

Defined results. NULL text is empty. A NULL or empty language is the part ``''``.
A document without an id is never a later copy and makes none. Rows that repeat
an id with the same text are first or later together. A document that ``labels``
names several times is good or toxic if any of its rows says so. An empty table
gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm.common import UPPER, split_words
from corvane.operators.once import once
from corvane.session import staged

# Fixed values of the contract.
FILTERS = "ABCDE"
FEWEST_WORDS = 100
LEAST_DIFFERENT_PERCENT = 80
MOST_UPPER_PERCENT = 10
MARKS = "[#$%&*|]"


def _mask(*fails: Column) -> Column:
    """Bit ``i`` is set where condition ``i`` holds."""
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def text_masks(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``doc_id, part, mask, digest``: the filters A to D, which see one text at a time."""
    rows = docs.select(
        F.col(id).alias("doc_id"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("body"),
    )
    rows = once(rows, words=split_words(F.col("body")))
    rows = rows.select(
        "doc_id",
        "part",
        "body",
        F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_different"),
    )
    upper = F.length("body") - F.length(F.translate("body", UPPER, ""))
    mask = _mask(
        F.col("n_words") < FEWEST_WORDS,
        100 * F.col("n_different") < LEAST_DIFFERENT_PERCENT * F.col("n_words"),
        100 * upper.cast("long") > MOST_UPPER_PERCENT * F.length("body").cast("long"),
        F.col("body").rlike(MARKS),
    )
    return rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("body", 256)).alias("digest"))


def later_copies(rows: DataFrame) -> DataFrame:
    """Add ``copied``: whether a smaller id has the same text."""
    firsts = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    firsts = firsts.select("first_id", F.col("digest").alias("first_digest"))
    own = (F.col("doc_id") == F.col("first_id")) & (F.col("digest") == F.col("first_digest"))
    copied = F.col("doc_id").isNotNull() & F.col("first_id").isNull()
    return rows.join(firsts, own, "left").withColumn("copied", copied).drop("first_id", "first_digest")


def weigh(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, docs, good, toxic``: how many documents of a part have a mask."""
    flags = labels.groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max(F.when(F.col("quality") == 1, 1)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1)).alias("toxic")
    )
    known = masks.join(flags, masks["doc_id"] == flags["labelled"], "left")
    return known.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("docs"), F.count("good").alias("good"), F.count("toxic").alias("toxic")
    )


def removal_steps(masks: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The step, from 0, at which each mask goes in each order; the number of filters where it stays.

    ``orders`` has the filters of every order by their bits.
    """
    filters = orders.shape[1]
    fails = (masks[:, None] >> np.arange(filters)) & 1
    cost = np.where(fails == 1, 0.0, np.inf)
    position = np.argsort(orders, axis=1).astype(float)  # the inverse of a permutation
    steps = (cost[:, None, :] + position[None, :, :]).min(axis=2)
    return np.where(np.isinf(steps), filters, steps).astype(np.int64)


def chain(weights: pd.DataFrame, orders: np.ndarray, names: Sequence[str]) -> pd.DataFrame:
    """All orders and steps of one part."""
    masks = weights["mask"].to_numpy()
    steps, (count, filters) = removal_steps(masks, orders), orders.shape
    at = (np.broadcast_to(np.arange(count), steps.shape), steps)

    def scattered(weight: np.ndarray) -> np.ndarray:
        sums = np.zeros((count, filters + 1), dtype=np.int64)
        np.add.at(sums, at, np.broadcast_to(weight[:, None], steps.shape))
        return sums[:, :filters]

    docs = weights["docs"].to_numpy()
    removed = scattered(docs)
    fails = (masks[:, None] >> np.arange(filters)) & 1
    failing, alone = docs @ fails, np.array([docs[masks == 1 << f].sum() for f in range(filters)])
    total = np.zeros(filters, dtype=np.int64)
    np.add.at(total, orders, removed)
    return pd.DataFrame(
        {
            "filter_order": np.repeat(["".join(names[f] for f in order) for order in orders], filters),
            "step": np.tile(np.arange(1, filters + 1), count),
            "kept": (docs.sum() - removed.cumsum(axis=1)).ravel(),
            "removed": removed.ravel(),
            # Who fails a filter and is not removed by it went before.
            "redundant": (failing[orders] - removed).ravel(),
            "unique_fails": alone[orders].ravel(),
            "good_lost": scattered(weights["good"].to_numpy()).ravel(),
            "toxic_lost": scattered(weights["toxic"].to_numpy()).ravel(),
            "shapley": total[orders].ravel(),
        }
    )


def interactions(weights: DataFrame, names: Sequence[str] = FILTERS) -> DataFrame:
    """Every part, order and step of the weighted masks; bit ``i`` of a mask is filter ``names[i]``.

    A group is one part's different masks: 2 to the number of filters at most.
    """
    orders = np.array(list(permutations(range(len(names)))))
    longs = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs)

    def grid(rows: pd.DataFrame) -> pd.DataFrame:
        found = chain(rows, orders, names)
        found.insert(0, "part", rows["part"].iloc[0])
        return found

    return weights.groupBy("part").applyInPandas(grid, schema)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over whole documents, in all orders, for every language."""
    rows = later_copies(staged(text_masks(docs), "text-masks"))
    last = F.when(F.col("copied"), 1 << FILTERS.index("E")).otherwise(0)
    return interactions(weigh(rows.withColumn("mask", F.col("mask") + last), labels))
