"""Exact top-k inner products by the threshold algorithm, in blocks.

Vectors are dealt into blocks, and each block becomes one row of a staged table: its vectors
and, for every dimension, its rows sorted by component, so lists are sorted once. Queries are
dealt into blocks as large as a task can hold, and each meets shards of several blocks of
vectors. For one query the algorithm reads a block's lists in step, from the end that the
query's sign favours, scores every row that comes up for the first time, and stops when no
unseen row can still beat the k-th score found: none scores above the sum of what the lists
would give next. The best k go on to the shard's next block, which stops the earlier for them.
Shards give their best k, and the best of those are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import staged

#: Rows of a block of vectors and of a block of queries, blocks of vectors in a shard; entries of each list read in a round.
VECTOR_ROWS, QUERY_ROWS, SHARD_BLOCKS, FIRST_DEPTH = 4096, 65_536, 8, 16


#: Components must be smaller than this once scaled, so that they are exact as long integers.
LIMIT = float(1 << 63)


def to_integers(vector: Column, scale: int) -> Column:
    """Each component as floor(scale * x); null if the vector or a component is null, NaN or infinite.

    A finite component that passes a long integer stops the job rather than being cut to its bounds.
    """
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = lambda x: F.lit(scale) * x.cast("double")
    whole = lambda x: F.when(F.abs(scaled(x)) < LIMIT, F.floor(scaled(x)).cast("long")).otherwise(F.raise_error(F.lit("a scaled component passes a long integer")).cast("long"))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, whole))


#: No ids and no scores yet.
NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Lists:
    """One block of vectors, in the order of their ids, with its rows sorted by each component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray):
        self.ids, self.vectors, self.sorted = ids, vectors, order  # order: for each dimension its rows by component
        self.doubles = self.vectors.astype(np.float64)
        self.most = float(np.abs(self.doubles).max(initial=0))
        self.values = np.ascontiguousarray(np.take_along_axis(self.vectors.T, self.sorted, axis=1))

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> Lists:
        by_id = np.argsort(ids, kind="stable")
        vectors = vectors[by_id]
        return cls(ids[by_id], vectors, np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.ids.tobytes(), self.vectors.tobytes(), self.sorted.astype(np.uint16).tobytes()

    @classmethod
    def unpacked(cls, ids: bytes, vectors: bytes, order: bytes) -> Lists:
        n = len(ids) // 8
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.int64).reshape(n, -1), np.frombuffer(order, np.uint16).reshape(-1, n))

    def bound(self, query: np.ndarray) -> float:
        """What no sum in a score can pass, rounded up."""
        return self.most * float(np.abs(query.astype(np.float64)).sum()) * (1 + 1e-9)

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products; in doubles, which are exact up to 2^53, wherever no sum can pass that."""
        if self.bound(query) < 1 << 53:
            return (self.doubles[rows] @ query.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ query

    def top_of_large(self, own: int, query: np.ndarray, k: int, before: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """As `top`, by Python's integers over all rows, where sums may pass a long integer."""
        found = self.vectors.astype(object) @ query.astype(object)
        rows = [(-score, vec_id) for score, vec_id in zip(found, self.ids.tolist()) if vec_id != own]
        best = sorted([*rows, *((-int(score), vec_id) for vec_id, score in zip(*(part.tolist() for part in before), strict=True))])[:k]
        if any(not -LIMIT <= -score < LIMIT for score, _ in best):
            raise OverflowError(f"a score of query {own} passes a long integer")
        return np.array([vec_id for _, vec_id in best], np.int64), np.array([-score for score, _ in best], np.int64)

    def top(self, own: int, query: np.ndarray, k: int, before: tuple[np.ndarray, np.ndarray] = NONE) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best of this block and ``before``, ties to smaller ids; never the id ``own``."""
        if self.bound(query) >= LIMIT:
            return self.top_of_large(own, query, k, before)
        n = len(self.ids)
        best, scores = before
        if not query.any():  # every row scores 0: the lists say nothing, the smallest ids win
            ids = np.sort(np.concatenate([best, self.ids[self.ids != own][:k]]))[:k]
            return ids, np.zeros(len(ids), np.int64)
        up, down = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
        unseen, at, depth = self.ids != own, 0, FIRST_DEPTH
        while at < n:
            if len(best) == k:
                bound = int(self.values[down, n - 1 - at] @ query[down] + self.values[up, at] @ query[up])
                if bound < scores[-1]:  # at equality an unseen row could tie with a smaller id
                    break
            stop = min(n, at + depth)
            came = np.zeros(n, bool)
            came[self.sorted[down, n - stop : n - at]] = True
            came[self.sorted[up, at:stop]] = True
            came &= unseen
            unseen &= ~came
            fresh = np.flatnonzero(came)
            found = self.scores(fresh, query)
            if len(best) == k:  # only what can still enter the best
                fresh, found = fresh[found >= scores[-1]], found[found >= scores[-1]]
            elif len(found) > k:
                enough = found >= np.partition(found, len(found) - k)[len(found) - k]
                fresh, found = fresh[enough], found[enough]
            best, scores = np.concatenate([best, self.ids[fresh]]), np.concatenate([scores, found])
            kept = np.lexsort((best, -scores))[:k]
            best, scores = best[kept], scores[kept]
            at, depth = stop, 2 * depth
        return best, scores


def _vector_block(rows: pd.DataFrame) -> pd.DataFrame:
    lists = Lists.of(rows["vec_id"].to_numpy(np.int64), np.stack(rows["ints"].to_numpy()).astype(np.int64))
    return pd.DataFrame([(rows["block"].iloc[0], lists.vectors.shape[1], *lists.packed())], columns=["block", "dims", "ids", "vectors", "sorted"])


def _shard_top(k: int):
    def run(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if queries.empty or blocks.empty:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})
        asked = np.stack(queries["ints"].to_numpy()).astype(np.int64)
        best = [NONE] * len(asked)
        for block in zip(blocks["ids"], blocks["vectors"], blocks["sorted"], strict=True):
            lists = Lists.unpacked(*block)
            best = [lists.top(own, query, k, found) for own, query, found in zip(queries["query_id"], asked, best, strict=True)]
        out = [np.stack([np.full(len(ids), own), ids, scores], axis=1) for own, (ids, scores) in zip(queries["query_id"], best, strict=True)]
        return pd.DataFrame(np.concatenate(out), columns=columns)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best by integer inner product, all if fewer.

    ``vectors`` has vec_id and embedding, ``queries`` query_id and embedding. A query never finds
    its own id; ties go to the smaller vec_id. Vectors that are null or hold null or non-finite
    components, and rows without id, take no part; a query meets only vectors of its own length,
    and empty vectors none. Repeated vector rows count once per (id, vector), repeated queries
    likewise. Empty tables give an empty result. Other columns are left out. Sums that may pass
    a long integer are taken in Python's integers; a component or one of the k best scores of a
    block that does pass one stops the job with an error.

    A task holds a shard of SHARD_BLOCKS blocks or fewer and QUERY_ROWS queries. Vectors are read
    once for each block of queries, queries once for each shard.
    """
    rows = vectors.select("vec_id", to_integers(F.col("embedding"), scale).alias("ints"))
    rows = rows.where(F.col("ints").isNotNull() & F.col("vec_id").isNotNull() & (F.size("ints") > 0))
    asked = queries.select("query_id", to_integers(F.col("embedding"), scale).alias("ints"))
    asked = asked.where(F.col("ints").isNotNull() & F.col("query_id").isNotNull() & (F.size("ints") > 0))
    # Enough blocks that each stays near its size; all counts grow with their tables.
    n_vectors, n_queries = (max(1, -(-table.count() // each)) for table, each in ((vectors, VECTOR_ROWS), (queries, QUERY_ROWS)))
    n_shards = max(-(-n_vectors // SHARD_BLOCKS), min(n_vectors, vectors.sparkSession.sparkContext.defaultParallelism))
    mixed = lambda c, n: F.pmod(F.xxhash64(c, "ints"), F.lit(n)).cast("int")
    dealt = rows.distinct().withColumn("block", mixed("vec_id", n_vectors))
    blocks = dealt.groupBy("block", F.size("ints").alias("dims")).applyInPandas(_vector_block, "block int, dims int, ids binary, vectors binary, sorted binary")
    blocks = staged(blocks, "vector-blocks").withColumn("shard", F.pmod("block", F.lit(n_shards)).cast("int"))
    right = blocks.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    left = asked.distinct().withColumn("asked", mixed("query_id", n_queries)).withColumn("dims", F.size("ints"))
    left = left.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    keys = ("shard", "asked", "dims")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_shard_top(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
