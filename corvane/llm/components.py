"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.session import staged


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Edges ``u, v`` with ``m``, the least neighbour of ``u``.

    The minimum is combined before the shuffle and joined back, so that a node
    with very many neighbours is spread over tasks by skew-join splitting.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _least_neighbour(both).withColumn("m", F.least("u", "m"))
    return near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    near = _least_neighbour(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    ends = near.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return ends.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the least node.

    Each round writes its edges to the shared folder, so that no lineage grows
    and a lost executor costs at most the round. The loop ends when a round
    changes nothing, after about the logarithm of the largest component's width.
    """
    now = staged(edges.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
    digest = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == digest or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        digest = state
        now = staged(_small_star(_large_star(now)), "edges")
