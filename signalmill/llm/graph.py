"""Connected components of a graph too large for one machine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, written

#: Edges that a task contracts at once, and that it gets at least where there are more.
PIECE = 1 << 17


def _forest(own: bool):
    """For mapInArrow over (u, v): an edge from each node to the least one that the piece's edges reach; with own, also that one's to itself."""

    def work(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, int] = {}

        def top(x: int) -> int:
            while tops.setdefault(x, x) != x:
                tops[x] = x = tops[tops[x]]
            return x

        def stars() -> pa.RecordBatch:
            ends = [(x, r) for x in list(tops) if (r := top(x)) != x or own]
            tops.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in ends], pa.int64()), pa.array([r for _, r in ends], pa.int64())], names=["u", "v"])

        for chunk in chunks:
            for u, v in zip(chunk.column("u").to_pylist(), chunk.column("v").to_pylist(), strict=True):
                x, y = top(u), top(v)
                if x != y:
                    tops[max(x, y)] = min(x, y)
            if len(tops) > 2 * PIECE:
                yield stars()
        yield stars()

    return work


def _contracted(edges: DataFrame) -> tuple[DataFrame, bool]:
    """The edges of a written table as stars of each task's piece, and whether there is but one piece.

    The number of tasks follows the number of edges, which is counted.  The stars of one
    piece hold its roots' edges to themselves, too.
    """
    tasks = max(1, math.ceil(edges.count() / PIECE))
    return edges.coalesce(tasks).mapInArrow(_forest(tasks == 1), "u bigint, v bigint"), tasks == 1


def _toward_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One step of the star method: link neighbours to the least among a node and its neighbours.

    larger_only: of the neighbours on both sides, those above the node are linked (large star);
    else those below it and the node itself (small star).  Minima are combined before the
    shuffle, and the join that brings them to the edges may be split where a node is hot.
    """
    if larger_only:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    with_least = edges.join(least, "u")
    if larger_only:
        out = with_least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        below = with_least.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = below.unionByName(least.where("u <> m").select("u", F.col("m").alias("v")))
    return out.where("u <> v")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node of edges has one larger-to-smaller edge or is where such edges end."""
    rows, tails = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    return rows == tails and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) of every node with an edge of (u, v); the root is the least node reachable.

    Tasks contract their pieces of the edges to stars; then large and small stars alternate
    until only stars are left, which takes a logarithmic number of rounds.  Each round is
    contracted again and written to the shared folder.  One piece needs no round.
    """
    edges = written(edges.where("u <> v").select("u", "v"), "links", spread=True)  # the links may still have to be found
    for _ in range(most_rounds):
        stars, whole = _contracted(edges)
        now = written(stars if whole else stars.distinct(), "edges")
        dropped(edges.sparkSession, edges)
        edges = now
        if whole:
            return edges.toDF("node", "root")
        if _is_stars(edges):
            break
        now = written(_toward_least(_toward_least(edges, True), False).distinct(), "edges")
        dropped(edges.sparkSession, edges)
        edges = now
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
