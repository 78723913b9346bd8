"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, floor(scale * x). Candidates are cut into blocks of like length (norm), longest first; a block keeps
its largest norm. A query block meets the candidate blocks in that order and keeps its k best so far, whose worst is the
threshold. For a block the threshold over the product of the norms is the cosine that a candidate would need: above 1 the
block is skipped; else the query takes, from the block's own sorted lists, either the candidates long enough (length
pruning) or those whose coordinate lies in the range that the cosine allows (coordinate pruning), whichever leaves fewer,
and only those products are computed. Bounds are widened by rounding margins, scores are exact integers.

Queries form groups of about 4,096, candidate blocks slices of about 32. A task gets one group and one slice: first the
queries, then the blocks one at a time, longest first. Its lists, k per query, are merged with the other slices'. Bounded
groups meet bounded slices; no pair of rows is ever a row of a table.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
fewer than k candidates give fewer rows; ties go to the smaller id; rows that repeat an id are candidates each, and a query's
own row is the row itself, so a repeated query row is asked and answered once for each row; shorter vectors are padded with
zeros; zero and empty vectors score 0; an empty table gives an empty table; other columns are not read. Scores must fit in
64 bits: components times ``scale`` are limited to 2**31 / sqrt(dimensions) or so, beyond which the task raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, written

BLOCK, QUERIES, SLICE = 2048, 4096, 32


class Block:
    """Candidates by falling norm, with each coordinate's order made when first asked for."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -norms))
        self.ids, self.rows, self.vectors, self.norms = ids[order], rows[order], vectors[order], norms[order]
        self.unit = self.vectors / np.maximum(self.norms, 1e-300)[:, None]
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self._lists[f] = order, self.unit[order, f]
        return self._lists[f]


def candidates(b: Block, q: np.ndarray, q_norm: float, threshold: float, focus: int = 3) -> np.ndarray | None:
    """Positions in the block that may reach the threshold (inclusive); None when none can."""
    if q_norm == 0 or threshold <= 0 or not len(b.norms):
        return np.arange(len(b.norms)) if threshold <= 0 else None
    if q_norm * b.norms[0] * (1 + 1e-9) < threshold:
        return None
    long_enough = int(np.searchsorted(-b.norms, -threshold / q_norm * (1 - 1e-9), side="right"))
    cosine = min(1.0, threshold / (q_norm * b.norms[0]) * (1 - 1e-9))
    unit = q / q_norm
    best: tuple[int, int, int, int] | None = None
    for f in np.argsort(-np.abs(unit))[:focus].tolist():
        x = float(unit[f])
        spread = np.sqrt(max(0.0, 1 - cosine * cosine) * max(0.0, 1 - x * x)) + 1e-9
        low = -1.0 if x <= -cosine else cosine * x - spread
        high = 1.0 if x >= cosine else cosine * x + spread
        values = b.by_coordinate(f)[1]
        lo, hi = np.searchsorted(values, low - 1e-9), np.searchsorted(values, high + 1e-9, side="right")
        if best is None or hi - lo < best[1] - best[0]:
            best = (int(lo), int(hi), f, 0)
    if best is not None and best[1] - best[0] < long_enough:
        picked = b.by_coordinate(best[2])[0][best[0] : best[1]]
        return picked[picked < long_enough]
    return np.arange(long_enough)


def products(vectors: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products: doubles while every partial sum fits in 53 bits, 64-bit integers beyond."""
    if largest < 2.0**53:
        return (vectors.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if largest >= 2.0**63:
        raise OverflowError("inner products of these vectors do not fit in 64 bits")
    return vectors @ q


class Best:
    """The k best (score, smaller id, row) of one query."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.row = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def threshold(self) -> float:
        return float(self.score[-1]) if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(self.score) == self.k:
            near = score >= self.score[-1]
            score, ids, rows = score[near], ids[near], rows[near]
        s, i, r = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.row, rows])
        keep = np.lexsort((r, i, -s))[: self.k]
        self.score, self.id, self.row = s[keep], i[keep], r[keep]


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def _packed(vectors: DataFrame, block: Column) -> DataFrame:
    """One row per block: ids, rows and components of its vectors."""
    one = F.sort_array(F.collect_list(F.struct("vec_id", "row", "v"))).alias("m")
    return vectors.groupBy(block.alias("block")).agg(one, F.max("norm").alias("norm"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows. ``vectors``: vec_id, embedding; ``is_query`` on vec_id."""
    spark = vectors.sparkSession
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
    fine &= ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    held = written(rows.withColumn("norm", norm), "vectors")
    # buckets of like norm, cut by hash into blocks of BLOCK: a bucket may hold all vectors
    bucket = F.floor(F.log2(F.col("norm") + 1) * 4).cast("int")
    sizes = held.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))  # at most 4 x 64 rows
    sized = held.withColumn("bucket", bucket).join(F.broadcast(sizes), "bucket")
    part = F.pmod(F.xxhash64("row"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))).cast("int")
    data = written(_packed(sized, F.struct("bucket", part.alias("part"))), "blocks").select(F.struct("block.bucket", "block.part").alias("block"), "m", "norm")
    n_blocks = data.count()
    asked = held.filter(is_query)
    n_groups = max(1, -(-asked.count() // QUERIES))
    group = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_groups)).cast("int")
    queries = _packed(asked.withColumn("part", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(16)).cast("int")), F.struct(group.alias("group"), "part"))
    # a task's share: one group of queries, and up to SLICE blocks, or fewer to give every core some
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-n_blocks // SLICE), min(n_blocks, partitions // n_groups))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("block.group", every(slices).alias("slice"), F.lit(0).alias("kind"), "norm", "m")
    right = data.select(F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice"), every(n_groups).alias("group"), F.lit(1).alias("kind"), "norm", "m")
    dealt = left.unionByName(right).repartition(max(partitions, slices * n_groups), "group", "slice").sortWithinPartitions("group", "slice", "kind", F.desc("norm"))

    def matrix(members: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = members.field("v")
        n, flat = v.value_lengths().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(n), max(1, int(n.max(initial=0)))), np.int64)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(np.arange(len(n)), n), at] = flat
        return members.field("vec_id").to_numpy(zero_copy_only=False), members.field("row").to_numpy(zero_copy_only=False), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asks = None, []

        def result() -> pa.RecordBatch:
            cols = [np.repeat([a[i] for a in asks], [len(a[3].score) for a in asks]).astype(np.int64) for i in (0, 1)]
            cols += [np.concatenate([getattr(a[3], c) for a in asks]) for c in ("id", "row", "score")]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "query_row", "vec_id", "row", "score"])

        for batch in batches:
            group, part, kind, m = (column(batch, c) for c in ("group", "slice", "kind", "m"))
            for i in range(batch.num_rows):
                if (group[i].as_py(), part[i].as_py()) != key:
                    if asks:
                        yield result()
                    key, asks = (group[i].as_py(), part[i].as_py()), []
                ids, own_rows, vec = matrix(m.slice(i, 1).flatten())
                if kind[i].as_py() == 0:
                    asks += [(a, r, v, Best(k)) for a, r, v in zip(ids.tolist(), own_rows.tolist(), vec, strict=True)]
                    continue
                block = Block(ids, own_rows, vec)
                for _, row, v, best in asks:
                    q = np.zeros(vec.shape[1], np.int64)
                    q[: len(v)] = v[: len(q)]  # components that the block lacks meet zeros
                    q_norm = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
                    some = candidates(block, q.astype(np.float64), q_norm, best.threshold)
                    if some is None or not len(some):
                        continue
                    some = some[block.rows[some] != row]
                    best.add(products(block.vectors[some], q, q_norm * block.norms[0] * 1.001), block.ids[some], block.rows[some])
        if asks:
            yield result()

    lists = dealt.select("group", "slice", "kind", "m").mapInArrow(run, "query_id long, query_row long, vec_id long, row long, score long")
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "row")))  # k from each slice at most
    merged = lists.groupBy("query_id", "query_row").agg(F.slice(order, 1, k).alias("m"))
    out = merged.select("query_id", F.posexplode("m").alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
