"""Nearest neighbours of a query set by a block matrix join on quantised vectors.

Queries and candidates are dealt into blocks, and every block of queries meets
every block of candidates in one cell. A cell quantises its vectors to int8,
gets all dot products of a tile by one matrix product (exact: the products are
small whole numbers), and from them the distance of the quantised vectors. That
is off by at most the two quantisation errors, which are known: a candidate
whose lower bound lies above the k-th best upper bound, or above the worst of
the best found so far, is out. The others are computed anew from the original
vectors in double precision and go to a heap per query; the cells' heaps are
merged by rank. The answer is exact.

Blocks have a bounded number of vectors, dealt by row number and not by value,
so many copies of one vector are spread like any others.

Defined results. Vectors that are NULL, empty or zero, or have NULL or
non-finite components, take no part, nor do NULL ids. Vectors of another
length than the query's are no candidates. Rows with a query's id are its own.
A repeated candidate row is a candidate each time; of repeated query rows the
smallest vector asks. Equal distances: the smaller id is nearer. Components may
be of any finite size: bounds are taken after a cell's vectors are scaled by a
power of two, and distances whose squares leave the range of doubles are summed
up scaled; only a distance beyond that range itself is infinite. An empty table
gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

NEAREST = 10
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 4096
TINY = 1e-140  # far below any bound that matters, its square far above the least double
TILE = 1024  # candidates, and at most a quarter as many queries, in one matrix product


def takes_part(id: Column, vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return id.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Quantised:
    """Vectors of components up to 1 as int8 codes with a scale each, and how far off each may be."""

    def __init__(self, vectors: np.ndarray):
        self.scale = np.abs(vectors).max(axis=1) / 127
        self.scale[self.scale == 0] = 1  # a largest component too small to divide
        self.codes = np.rint(vectors / self.scale[:, None]).astype(np.int8)
        rounded = self.codes * self.scale[:, None]
        self.squares = np.square(rounded).sum(axis=1)
        # A little is added for the rounding of the sums themselves, and for squares that are too small to add up.
        self.off = np.sqrt(np.square(vectors - rounded).sum(axis=1)) + 1e-7 * np.sqrt(self.squares) + TINY

    def bounds(self, queries: slice, other: "Quantised", candidates: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the distances of a tile."""
        codes, others = self.codes[queries], other.codes[candidates]
        # Sums of products of int8 numbers are exact in 32-bit floats up to 1,040 components.
        kind = np.float32 if codes.shape[1] <= 1040 else np.float64
        dots = (codes.astype(kind) @ others.astype(kind).T).astype(np.float64)
        dots *= self.scale[queries][:, None] * other.scale[candidates][None, :]
        sums = self.squares[queries][:, None] + other.squares[candidates][None, :]
        far = np.sqrt(np.maximum(sums - 2 * dots, 0))
        off = self.off[queries][:, None] + other.off[candidates][None, :] + 1e-7 * np.sqrt(sums)
        return far - off, far + off


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances of pairs, components added up in order."""
    with np.errstate(over="ignore", under="ignore"):
        total = np.zeros(len(left))
        for d in range(left.shape[1]):
            total += np.square(left[:, d] - right[:, d])
        odd = np.flatnonzero(~((total > TINY**2) & (total < np.inf)))
        odd = odd[(left[odd] != right[odd]).any(axis=1)]
        far = np.sqrt(total)
        if len(odd):
            power = exponent(np.maximum(np.abs(left[odd]), np.abs(right[odd])))
            apart = np.ldexp(left[odd], -power[:, None]) - np.ldexp(right[odd], -power[:, None])
            more = exponent(apart)
            far[odd] = np.ldexp(np.sqrt(np.square(np.ldexp(apart, -more[:, None])).sum(axis=1)), power + more)
    return far


def exponent(vectors: np.ndarray) -> np.ndarray:
    """The power of two above every vector's largest component."""
    return np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1]


def nearest_in_cell(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> list[tuple[int, int, float]]:
    """``(query, candidate, distance)`` of the ``k`` nearest candidates of every query."""
    power = int(max(exponent(queries).max(), exponent(vectors).max()))
    asked, offered = Quantised(np.ldexp(queries, -power)), Quantised(np.ldexp(vectors, -power))
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]  # worst first: signs are turned
    step = TILE // 4
    for at in range(0, len(ids), TILE):
        some = slice(at, at + TILE)
        for first in range(0, len(query_ids), step):
            part = slice(first, first + step)
            lower, upper = asked.bounds(part, offered, some)
            own = query_ids[part][:, None] == ids[some][None, :]
            upper[own] = np.inf
            limit = np.full(len(lower), np.inf)
            if upper.shape[1] > k:
                limit = np.partition(upper, k - 1, axis=1)[:, k - 1]
            worst = np.array([-h[0][0] if len(h) == k else np.inf for h in heaps[part]])
            limit = np.minimum(limit, np.ldexp(worst, -power))
            row, column = np.nonzero((lower <= limit[:, None]) & ~own)
            exact = distances(queries[first + row], vectors[at + column])
            for q, far, id in zip((first + row).tolist(), exact.tolist(), ids[at + column].tolist()):
                entry = (-far, -id)
                if len(heaps[q]) < k:
                    heapq.heappush(heaps[q], entry)
                elif entry > heaps[q][0]:
                    heapq.heapreplace(heaps[q], entry)
    return [(int(q), -id, -far) for q, heap in zip(query_ids, heaps) for far, id in heap]


def nearest(
    rows: DataFrame,
    asks: Column,
    k: int = NEAREST,
    id: str = "vec_id",
    vector: str = "embedding",
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of every row that ``asks``.

    ``asks`` is a condition on the column ``vec_id``.
    """
    valid = rows.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    valid = valid.filter(takes_part(F.col("vec_id"), F.col("vector"))).withColumn("length", F.size("vector"))
    queries = valid.filter(asks).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    counted = valid.agg(F.count(F.lit(1)).alias("n"), F.count_if(asks).alias("q")).first()
    across = max(1, math.ceil(counted["n"] / candidate_block))
    down = max(1, math.ceil(counted["q"] / query_block))

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    dealt = F.pmod(F.monotonically_increasing_id(), F.lit(across)).cast("int")
    candidates = valid.withColumn("across", dealt).withColumn("down", every(down))
    asked = (
        queries.withColumn("length", F.size("vector"))
        .withColumn("down", F.pmod(F.xxhash64("vec_id"), F.lit(down)).cast("int"))
        .withColumn("across", every(across))
    )
    cell = ["length", "down", "across"]
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        vectors = table.column("vector").combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return table.column("vec_id").to_numpy(), flat.reshape(len(vectors), -1)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = nearest_in_cell(*matrix(left), *matrix(right), k)
        return pa.Table.from_arrays(
            [pa.array([f[i] for f in found], type=kinds.types[i]) for i in range(3)], schema=kinds
        )

    pairs = asked.groupBy(*cell).cogroup(candidates.groupBy(*cell)).applyInArrow(
        meet, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
