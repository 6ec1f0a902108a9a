"""Approximate nearest neighbours by collision-counting hashing with query-centred windows.

Every vector is projected on ``LINES`` random lines; a block of vectors keeps, for each line, its
projections in a sorted array. A query opens a window round its own projection on each line, at first one that holds about
a share ``FIRST`` of the projections: narrower ones make hardly any vector collide often enough, and cost a step each. By
virtual rehashing the windows widen in steps, always containing the earlier ones, and a vector collides
once for each line whose window holds it. A vector that collides on ``SHARE`` of the lines is verified by
its true distance.

When to stop follows from the radius alone. The projections of two vectors at distance d differ by d times
a standard normal number, so a window of half-width ``REACH`` * d makes a vector at distance d or less
collide on enough lines with probability ``SURE`` or more. The windows widen until they reach so far for
the k-th nearest vector verified: each vector that belongs among the k nearest has been verified with that
probability. Where fewer than k vectors are verified the windows widen until they hold all.

Vectors are cut into blocks of about ``BLOCK`` rows and stated queries into batches of about ``BATCH``, both
by a hash; each batch meets each block in one group of bounded size, which returns the k nearest of each
query, of which the k nearest overall are kept. Vectors of different lengths have no distance: those of each
length are searched among themselves.

Nearness is the Euclidean distance in double precision on the original vectors; ties go to the smaller
vec_id. Defined cases: vectors that are null, zero, or hold null or non-finite components take no part,
neither do rows without vec_id; repeated rows are candidates as often as they occur; a query that occurs
more than once is asked once, all rows of its vec_id are left out for it, and an id with several
vectors is asked for each of them with ranks of its own; a query with fewer candidates than k gets all; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import cut

LINES, SHARE, SURE, GROWTH, FIRST = 192, 0.7, 0.9, 1.15, 0.25
BLOCK, BATCH, SEED = 16_384, 4_096, 7
#: Different lengths of vectors whose numbers of blocks are broadcast at most.
BROADCAST_LENGTHS = 100_000
NEED = math.ceil(SHARE * LINES)


def _enough(p: float) -> float:
    """The chance of at least NEED collisions on LINES lines, each with probability p."""
    return sum(math.comb(LINES, j) * p**j * (1 - p) ** (LINES - j) for j in range(NEED, LINES + 1))


def reach() -> float:
    """The half-width, in distances, at which a vector collides on enough lines with probability SURE."""
    low, high = 0.0, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if _enough(math.erf(middle / math.sqrt(2))) >= SURE else (middle, high)
    return high


REACH = reach()


@cache
def lines(dimensions: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dimensions, LINES))


class Block:
    """The vectors of a block with their sorted projections, line after line in one array."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order], np.float64)
        shadows = (self.vectors @ lines(vectors.shape[1])).T
        self.order = np.argsort(shadows, axis=1).astype(np.int32)
        self.sorted = np.take_along_axis(shadows, self.order.astype(np.int64), axis=1)
        #: Each line's projections are moved to a place of their own, so that one search serves all lines.
        self.span = 4 * (1.0 + float(np.abs(shadows).max(initial=0.0)))
        self.moved = (self.sorted + np.arange(LINES)[:, None] * self.span).ravel()
        self.order = self.order.ravel()
        self.verified = 0

    def _places(self, at: np.ndarray, side: str) -> np.ndarray:
        low = np.arange(LINES) * self.span
        n = len(self.ids)
        return np.clip(np.searchsorted(self.moved, low + np.clip(at, -self.span / 2, self.span / 2), side), np.arange(LINES) * n, (np.arange(LINES) + 1) * n)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n, shadow = len(self.ids), query @ lines(len(query))
        counts, verified = np.zeros(n, np.int64), self.ids == query_id
        found, distances = np.zeros(0, np.int64), np.zeros(0)
        left = right = self._places(shadow, "left")
        first, last = np.arange(LINES) * n, (np.arange(LINES) + 1) * n
        # the first windows hold a share FIRST of each line's projections, and k at least: in narrower ones few vectors collide often enough
        some = max(k, int(n * FIRST / 2))
        near = self.sorted.ravel()[np.clip([left - some, left + some], first, last - 1)]
        width = max(float(np.median(np.abs(near - shadow))), 1e-12)
        while True:
            a, b = self._places(shadow - width, "left"), self._places(shadow + width, "right")
            a, b = np.minimum(a, left), np.maximum(b, right)
            fresh = [self.order[i:j] for i, j in zip(np.concatenate([a, right]).tolist(), np.concatenate([left, b]).tolist(), strict=True) if i < j]
            if fresh:
                counts += np.bincount(np.concatenate(fresh), minlength=n)
            left, right = a, b
            hits = np.flatnonzero((counts >= NEED) & ~verified)
            if len(hits):
                verified[hits] = True
                self.verified += len(hits)
                found = np.concatenate([found, hits])
                distances = np.concatenate([distances, np.sqrt(((self.vectors[hits] - query) ** 2).sum(axis=1))])
            if (left == first).all() and (right == last).all():
                break
            if len(found) >= k:
                target = REACH * float(np.partition(distances, k - 1)[k - 1])
                if width >= target:
                    break
                width = min(width * GROWTH, target)
            else:
                width *= GROWTH
        best = np.lexsort((self.ids[found], distances))[:k]
        return self.ids[found[best]], distances[best]


def sound(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row that is_query marks."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & sound(F.col("embedding")))
    rows = cut(rows.withColumns({"length": F.size("embedding"), "place": F.monotonically_increasing_id()}), "vectors")  # a fixed number for each row from here on
    grid = rows.groupBy("length").agg(F.count("*").alias("n"), F.sum(F.coalesce(is_query, F.lit(False)).cast("long")).alias("asked"))
    grid = cut(grid.select("length", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asked") / BATCH).cast("int").alias("batches")).where("batches > 0"), "grid")
    sized = rows.join(F.broadcast(grid) if grid.count() <= BROADCAST_LENGTHS else grid, "length")
    queries = sized.where(is_query).dropDuplicates(["vec_id", "embedding"])
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    held = sized.withColumn("block", F.pmod(F.xxhash64("place"), F.col("blocks")).cast("int")).withColumn("batch", upto("batches"))
    asked = queries.withColumn("batch", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("batches")).cast("int")).withColumn("block", upto("blocks"))
    asked = asked.withColumn("query", F.xxhash64("embedding"))

    def search(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(queries):
            index = Block(block["vec_id"].to_numpy(), np.stack(block["embedding"].to_numpy()))
            for query_id, query, vector in zip(queries["query_id"].to_numpy(), queries["query"].to_numpy(), queries["vector"], strict=True):
                ids, distances = index.search(query_id, np.asarray(vector, float), k)
                out.append(pd.DataFrame({"query_id": query_id, "query": query, "vec_id": ids, "score": distances}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, int), "query": np.zeros(0, int), "vec_id": np.zeros(0, int), "score": np.zeros(0)})

    cell = ["length", "block", "batch"]
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in cell], F.col("vec_id").alias("query_id"), "query", F.col("embedding").alias("vector"))
    found = held.select(*cell, "vec_id", "embedding").groupBy(*cell).cogroup(asked.groupBy(*[f"q_{c}" for c in cell])).applyInPandas(search, "query_id long, query long, vec_id long, score double")
    first = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(first).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
