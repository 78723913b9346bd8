"""Connected components of an edge table by alternating large and small stars; every round is a few joins on Spark.

Before the first round and after every step a task ties what it holds by union-find, so that it passes on a star for each group that it
sees: edges and rounds become fewer, and equal edges need no shuffle to meet. A round's tables are stored and the former round's
deleted. The least neighbours are stored before they are joined, so that both sides of that join come from exchanges of its own,
which adaptive execution splits where a node has very many edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, written

#: Edges that a task ties at once, and rows that are worth a partition of their own.
TIED, LEAST_ROWS = 1 << 18, 1 << 14


def star_edges(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Edges from each node to the least node that the edges (a, b) tie it to."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while (j := up.setdefault(i, i)) != i:
            up[i] = up[j]
            i = up[j]
        return i

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    nodes = [i for i, j in up.items() if i != j]
    return nodes, [root(i) for i in nodes]


def _tied(pairs: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, with the components of ``pairs``: of each task's edges, up to TIED at a time, the stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in star_edges(*held)], ["a", "b"])

        held: tuple[list[int], list[int]] = ([], [])
        for batch in batches:
            for kept, c in zip(held, ("a", "b"), strict=True):
                kept += column(batch, c).to_pylist()
            if len(held[0]) >= TIED:
                yield stars()
                held = ([], [])
        if held[0]:
            yield stars()

    return pairs.select("a", "b").mapInArrow(run, "a long, b long")


def _parts(rows: int) -> int:
    """Partitions for so many rows: a table that has shrunk is not written as a file for each of the shuffle's partitions."""
    return 1 + rows // LEAST_ROWS


def _least(pairs: DataFrame) -> DataFrame:
    """(k, m): m is the least of node k and its neighbours. Minima combine before the shuffle."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("m", "a").alias("m"))
    return written(least.coalesce(_parts(pairs.count())), "least")


def _stars(e: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none leads to a node with another."""
    ends = e.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("b").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR down = 1 AND up = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to a stored (node, component), component being the least node reachable. Nodes without edges are absent."""
    e = written(_tied(edges), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both)
        large = both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = written(_tied(large), "down")
        discard(least, e)
        least = _least(down)
        small = down.join(least, F.col("a") == F.col("k"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
        e = written(_tied(small), "edges")
        discard(least, down)
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    found = written(found.coalesce(_parts(2 * e.count())), "components")
    discard(e)
    return found
