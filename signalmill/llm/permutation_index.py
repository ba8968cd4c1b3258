"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors.  A vector is represented by its
nearest pivots in order, and posted under each of them, with its place in that
order, in the inverted files of its shard.  A query walks the files of its own
nearest pivots in every shard; the places met give the footrule distance of the
two orders.  Vectors are reranked by inner product in order of that distance, in
rounds, until some rounds in a row bring none nearer than the nearest so far; no
round is the last by number.

Queries meet shards in blocks: a task holds one shard and one block of queries,
both of bounded size.  Equal vectors are one entry of the index with their
smallest ids, as many as a result can show.

Defined results: vectors that are null, zero, of another length than most, or that
hold null or non-finite components take no part, neither as queries nor as
candidates; a query's own row is no candidate, but others equal to it are; ties go
to the smaller id; rows with equal id are candidates once each, and each a query;
with few candidates all are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import written

#: Vectors of a shard, and queries of a block, at most about.
SHARD, BLOCK = 16_384, 4_096
#: Most pivots. The sample they are is all that is fitted.
MAX_PIVOTS = 4_096
#: A query's vectors are reranked in so many rounds, and until QUIET rounds bring nothing new.
ROUNDS, QUIET = 10, 3


def pivot_count(n: int) -> int:
    """A power of two that grows with the root of the number of vectors."""
    return min(MAX_PIVOTS, 1 << round(math.log2(max(16.0, 2.5 * math.sqrt(n)))))


def prefix_length(pivots: int) -> int:
    """How many nearest pivots represent a vector."""
    return max(1, min(pivots, math.ceil(math.sqrt(pivots)) + 4))


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def orders(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first."""
    s = vectors @ pivots.T
    if length >= s.shape[1]:
        return np.argsort(-s, axis=1, kind="stable").astype(np.int32)
    part = np.argpartition(-s, length - 1, axis=1)[:, :length]
    part.sort(axis=1)
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable"), 1).astype(np.int32)


class Shard:
    """Vectors with the inverted files of their pivots."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray, pivots: int):
        self.vectors, self.length = vectors, order.shape[1]
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows, self.places = (by_pivot // self.length).astype(np.int32), (by_pivot % self.length).astype(np.int32)
        self.files = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=pivots))])

    def nearest(self, query: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best found, and all that tie with the last."""
        n, m = len(self.vectors), self.length
        spans = [slice(self.files[p], self.files[p + 1]) for p in order]
        rows = np.concatenate([self.rows[s] for s in spans])
        # the footrule of two orders is m (m + 1) less twice the sum, over pivots in both, of m - the later place
        gains = np.concatenate([m - np.maximum(self.places[s], i) for i, s in enumerate(spans)])
        near = np.bincount(rows, gains, n)
        found = np.flatnonzero(near)
        if len(found) < k:  # the files don't fill the result: the rest of the shard comes last
            ranked = np.argsort(-near, kind="stable")
        else:
            ranked = found[np.argsort(-near[found], kind="stable")]
        step = max(4 * k, -(-len(ranked) // ROUNDS))
        rows, scores, quiet = ranked[:0], np.zeros(0), 0
        for at in range(0, len(ranked), step):
            more = ranked[at : at + step]
            new = self.vectors[more] @ query
            if len(scores) >= k:
                better = new >= least - 1e-9
                quiet = 0 if (new > least).any() else quiet + 1
                more, new = more[better], new[better]
            rows, scores = np.concatenate([rows, more]), np.concatenate([scores, new])
            if len(scores) >= k:
                least = np.partition(scores, -k)[-k]
                stay = scores >= least - 1e-9
                rows, scores = rows[stay], scores[stay]
            if quiet == QUIET:
                break
        # one way of summing for all, whatever block they came in
        return rows, (self.vectors[rows] * query).sum(axis=1)


def matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), float).reshape(-1, dim)


class PermutationIndex:
    """Of (vec_id, vector): the pivots and a written table of entries in shards."""

    def __init__(self, vectors: DataFrame, *, most_ids: int):
        vectors = vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).where(usable(F.col("vector")))
        sizes = vectors.groupBy(F.size("vector").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
        self.dim = sizes.d if sizes else 0
        # equal vectors: the window keeps few rows of each, before the shuffle as well
        same = W.partitionBy("vector").orderBy(F.col("vec_id").asc_nulls_last())
        few = vectors.where(F.size("vector") == self.dim).withColumn("r", F.row_number().over(same)).where(F.col("r") <= most_ids)
        entries = few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        entries = written(entries.withColumn("h", F.xxhash64("vector")), "entries")
        self.n = entries.count()
        m = pivot_count(self.n)
        chosen = entries.orderBy("h", "vector").limit(m).select("vector").collect()
        self.pivots = np.array([r.vector for r in chosen], float).reshape(len(chosen), self.dim)
        if len(chosen):
            self.pivots /= np.linalg.norm(self.pivots, axis=1, keepdims=True)
        self.length = prefix_length(max(1, len(chosen)))
        self.shards = max(1, -(-self.n // SHARD))
        self.entries = entries.withColumn("shard", F.pmod("h", F.lit(self.shards))).drop("h")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """Of (query_id, vector): query_id, rank, vec_id, score of the k nearest found; k < most_ids."""
        dim, pivots, length = self.dim, self.pivots, self.length
        queries = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where(usable(F.col("vector")) & (F.size("vector") == dim))
        # a row of its own number for each query, as ids may repeat
        queries = queries.withColumn("q", F.monotonically_increasing_id())
        queries = written(queries, "queries")
        blocks = max(1, -(-queries.count() // BLOCK))
        asked = queries.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.shards - 1).cast("bigint"))))
        posted = self.entries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        result = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

        def work(entries: pa.Table, asked: pa.Table) -> pa.Table:
            columns: list[list] = [[], [], [], []]
            if entries.num_rows and asked.num_rows:
                vectors, wanted = matrix(entries["vector"], dim), matrix(asked["vector"], dim)
                shard = Shard(vectors, orders(vectors, pivots, length), len(pivots))
                ids = entries["ids"].to_pylist()
                for q, own, v, o in zip(asked["q"].to_pylist(), asked["query_id"].to_pylist(), wanted, orders(wanted, pivots, length), strict=True):
                    rows, scores = shard.nearest(v, o, k + 1)
                    best = sorted((-s, x is None, x or 0) for r, s in zip(rows.tolist(), scores.tolist(), strict=True) for x in _without(ids[r], own, (v == vectors[r]).all()))[:k]
                    for c, values in zip(columns, ([q] * len(best), [own] * len(best), [None if gone else x for _, gone, x in best], [-s for s, _, _ in best]), strict=True):
                        c += values
            return pa.table([pa.array(c, f.type) for c, f in zip(columns, result, strict=True)], schema=result)

        found = posted.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(work, "q bigint, query_id bigint, vec_id bigint, score double")
        order = W.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _without(ids: list, own, equal: bool) -> list:
    """ids less the query's own row, once."""
    if equal and own in ids:
        ids = list(ids)
        ids.remove(own)
    return ids
