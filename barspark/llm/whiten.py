"""Embedding whitening on Spark MLlib's BlockMatrix: scatter by a transposed multiplication, local eigh, projection by a second one.

Entries become integers x = floor(64 * entry) + 1000000. Rows are cut into blocks of consecutive rows of a task, which are written
once with their place (task, number), so a block's index never depends on a second reading. The fit list holds each distinct x once.
Its rows, centred exactly as (n * x - S) / n in integers, are the blocks of a BlockMatrix M; M' M / n is the covariance V. The middle
dimension of that product is split, so that no task holds more than ``SPLIT`` blocks of rows. The eigenvectors of V (dimension by
dimension numbers on the driver) over the roots of their eigenvalues are the whitening matrix W; the blocks of all rows times W are
the result. Whitened rows have mean zero, being products of centred rows.

Defined results:

* a vector that is null, empty, or holds null, NaN or an infinity is left out; so is one whose length is not the commonest (the
  greatest of those equally common). An id may be null or repeated; every remaining row has its own result; extra columns are ignored;
* x saturates at +-2**62 (entries beyond 7e16);
* ``deviation`` is null where the exact sum does not fit a long;
* a direction without variance (eigenvalue up to 16 d eps of the trace) has ``whitened`` null and stays out of ``identity_error``;
  ``explained`` is null where the trace is 0, ``identity_error`` is 0 where no direction varies;
* there are min(16, d) components; an eigenvector's largest entry is positive (the first, if equal); no vectors, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import column, written

SHIFT = 1_000_000
#: Bytes of a block's doubles.
BLOCK_BYTES = 1 << 21
#: Columns of a block.
WIDTH = 1024
#: Blocks of rows that one task of a transposed multiplication takes.
SPLIT = 16
_TOP = 1 << 62

_BLOCK = "part int, k long, d int, n int, ids array<long>, x binary"
_PLACE = StructType([StructField("_1", LongType()), StructField("_2", LongType())])
_INDEXED = StructType([StructField("_1", _PLACE), StructField("_2", MatrixUDT())])
_UDT = pa.struct(
    [("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())), ("rowIndices", pa.list_(pa.int32())),
     ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())]
)


class _Gather:
    """Blocks of at most BLOCK_BYTES from rows that come in batches; rows of different lengths go to different blocks."""

    def __init__(self) -> None:
        self.part = TaskContext.get().partitionId()
        self.k = 0
        self.ids: dict[int, list[pa.Array]] = {}
        self.x: dict[int, list[np.ndarray]] = {}

    def add(self, ids: pa.Array, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        d = x.shape[1]
        self.ids.setdefault(d, []).append(ids)
        self.x.setdefault(d, []).append(x)
        most = max(1, BLOCK_BYTES // (8 * d))
        if sum(map(len, self.x[d])) >= most:
            yield from self._cut(d, most, False)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for d in list(self.x):
            yield from self._cut(d, max(1, BLOCK_BYTES // (8 * d)), True)

    def _cut(self, d: int, most: int, last: bool) -> Iterator[pa.RecordBatch]:
        ids, x = pa.concat_arrays(self.ids[d]), np.concatenate(self.x[d])
        at = 0
        while len(x) - at >= most or last and at < len(x):
            n = min(most, len(x) - at)
            yield pa.record_batch(
                [pa.array([self.part], pa.int32()), pa.array([self.k], pa.int64()), pa.array([d], pa.int32()), pa.array([n], pa.int32()),
                 pa.ListArray.from_arrays([0, n], ids.slice(at, n)), pa.array([x[at : at + n].tobytes()], pa.binary())],
                ["part", "k", "d", "n", "ids", "x"],
            )
            self.k, at = self.k + 1, at + n
        self.ids[d], self.x[d] = [ids.slice(at)], [x[at:]]


def _whole(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x without SHIFT) of the usable vectors, length by length."""
    flat = vectors.flatten().cast(pa.float64())
    size = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    value = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(size) - size
    bad = np.zeros(len(value) + 1, np.int64)
    np.cumsum(~np.isfinite(value), out=bad[1:])
    good = (size > 0) & (bad[start + size] == bad[start])
    for d in np.unique(size[good]):
        at = np.flatnonzero(good & (size == d))
        x = np.clip(np.floor(64.0 * value[start[at][:, None] + np.arange(d)]), -float(_TOP), float(_TOP))
        yield at, x.astype(np.int64)


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Gather()
    for batch in batches:
        ids = column(batch, "id")
        for at, x in _whole(column(batch, "vector")):
            yield from out.add(ids.take(pa.array(at)), x)
    yield from out.rest()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, n, x in zip(*(column(batch, c).to_pylist() for c in ("d", "n", "x")), strict=True):
            yield pa.record_batch([pa.array([x[i : i + 8 * d] for i in range(0, 8 * d * n, 8 * d)], pa.binary())], ["x"])


def _cut_distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Gather()
    for batch in batches:
        rows = column(batch, "x").to_pylist()
        if rows:
            yield from out.add(pa.nulls(len(rows), pa.int64()), np.frombuffer(b"".join(rows), np.int64).reshape(len(rows), -1))
    yield from out.rest()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and dimension the sums of the upper and lower halves of x, which no task can overflow."""
    high = low = None
    for batch in batches:
        for d, x in zip(column(batch, "d").to_pylist(), column(batch, "x").to_pylist(), strict=True):
            v = np.frombuffer(x, np.int64).reshape(-1, d)
            high = (v >> 32).sum(0) + (0 if high is None else high)
            low = (v & 0xFFFFFFFF).sum(0) + (0 if low is None else low)
    if high is not None:
        yield pa.record_batch([pa.array(np.arange(len(high))), pa.array(high), pa.array(low)], ["dim", "high", "low"])


class Fit(NamedTuple):
    """n distinct x-vectors of d entries with sums s (without SHIFT)."""

    n: int
    d: int
    s: list[int]

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs, or Python's integers where those could overflow."""
        most = max(int(x.max()), -int(x.min()), 1)
        if self.n * most + max(map(abs, self.s)) < _TOP:
            return self.n * x - np.array(self.s, np.int64)
        return self.n * x.astype(object) - np.array(self.s, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.spread(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        spread = self.spread(x)
        about = np.square(spread.astype(np.float64)).sum(1)
        if spread.dtype == np.int64 and (about < float(_TOP)).all():
            return pa.array(np.square(spread).sum(1), pa.int64())
        exact = [sum(int(v) ** 2 for v in row) if a < 2.0**63 * 1.01 else 1 << 63 for row, a in zip(spread, about, strict=True)]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _matrix_rows(places: list[dict], blocks: list[np.ndarray]) -> pa.RecordBatch:
    """Row-major blocks with their places, as MLlib stores them."""
    matrices = pa.StructArray.from_arrays(
        [pa.array([1] * len(blocks), pa.int8()), pa.array([b.shape[0] for b in blocks], pa.int32()), pa.array([b.shape[1] for b in blocks], pa.int32()),
         pa.nulls(len(blocks), pa.list_(pa.int32())), pa.nulls(len(blocks), pa.list_(pa.int32())),
         pa.ListArray.from_arrays(np.cumsum([0] + [b.size for b in blocks]).astype(np.int32), pa.array(np.concatenate([b.ravel() for b in blocks]))),
         pa.array([True] * len(blocks))],
        fields=list(_UDT),
    )
    return pa.record_batch([pa.array(places, pa.struct([("_1", pa.int64()), ("_2", pa.int64())])), matrices], ["_1", "_2"])


def _block_matrix(blocks: DataFrame, n_blocks: int, height: int, fit: Fit) -> BlockMatrix:
    """Centred rows of numbered blocks; a short block is filled with zero rows, which add nothing to any product."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, n, x in zip(*(column(batch, c).to_pylist() for c in ("no", "n", "x")), strict=True):
                rows = np.zeros((height, fit.d))
                rows[:n] = fit.centred(np.frombuffer(x, np.int64).reshape(n, fit.d))
                cuts = range(0, fit.d, WIDTH)
                yield _matrix_rows([{"_1": no, "_2": j} for j in range(len(cuts))], [rows[:, c : c + WIDTH] for c in cuts])

    indexed = blocks.select("no", "n", "x").mapInArrow(made, _INDEXED)
    return _as_matrix(indexed, height, min(WIDTH, fit.d), n_blocks * height, fit.d)


def _as_matrix(indexed: DataFrame, height: int, width: int, rows: int, cols: int) -> BlockMatrix:
    return BlockMatrix(callMLlibFunc("createBlockMatrix", indexed, height, width, rows, cols), height, width)


def _inner(m: BlockMatrix, n_blocks: int) -> np.ndarray:
    """M' M with a split middle dimension, gathered: columns by columns."""
    t = m.transpose()
    splits = -(-n_blocks // SPLIT)
    product = t._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, t.rowsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()


def _numbered(blocks: DataFrame) -> tuple[DataFrame, int, int]:
    """Blocks with their index ``no``, their number, and the rows of the largest. One row per task is numbered in one place."""
    parts = blocks.groupBy("part").agg(F.max("k").alias("last"), F.max("n").alias("height"))
    before = F.sum(F.col("last") + 1).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"), "last", "height")
    n, height = parts.agg(F.max(F.col("base") + F.col("last") + 1), F.max("height")).first()
    return blocks.join(parts.select("part", "base"), "part").withColumn("no", F.col("base") + F.col("k")), n, height


class Whitened(NamedTuple):
    """``rows``: id, deviation (long), whitened (array of doubles or null, by component). The rest holds for all rows."""

    rows: DataFrame
    n: int
    explained: list[float | None]
    identity_error: float
    vectors: np.ndarray


def whiten(vectors: DataFrame, id: str = "vec_id", column_: str = "embedding", components: int = 16) -> Whitened:
    """Whiten ``column_`` (array of float or double) along the first ``components`` eigenvectors of the distinct rows' covariance."""
    spark = vectors.sparkSession
    cut = written(vectors.select(F.col(id).cast("long").alias("id"), F.col(column_).alias("vector")).mapInArrow(_cut_rows, _BLOCK), "rows")
    common = cut.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return Whitened(spark.createDataFrame([], "id long, deviation long, whitened array<double>"), 0, [], 0.0, np.zeros((0, 0)))
    d = common["d"]
    cut = cut.filter(F.col("d") == d)
    distinct = written(cut.mapInArrow(_rows, "x binary").distinct().mapInArrow(_cut_distinct, _BLOCK), "distinct")
    sums = distinct.select("d", "x").mapInArrow(_sums, "dim long, high long, low long").groupBy("dim")
    sums = sums.agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).orderBy("dim").collect()
    fit = Fit(distinct.agg(F.sum("n")).first()[0], d, [int(r["high"]) * (1 << 32) + int(r["low"]) for r in sums])

    numbered, n_fit, height = _numbered(distinct)
    m = _block_matrix(numbered, n_fit, height, fit)
    v = _inner(m, n_fit) / fit.n
    values, directions = np.linalg.eigh((v + v.T) / 2)
    k = min(components, d)
    values, directions = values[::-1][:k], directions[:, ::-1][:, :k]
    directions = directions * np.sign(directions[np.abs(directions).argmax(0), np.arange(k)])
    trace = float(np.trace(v))
    varies = values > trace * d * 16 * np.finfo(float).eps
    w = np.where(varies, directions / np.sqrt(np.where(varies, values, 1.0)), 0.0)

    matrix = _whitening_matrix(spark, w)
    inner = _inner(_projected(m, matrix, height), n_fit) / fit.n - np.eye(k)
    error = float(np.abs(inner[np.ix_(varies, varies)]).max()) if varies.any() else 0.0

    numbered, n_rows, height = _numbered(cut)
    blocks = _projected(_block_matrix(numbered, n_rows, height, fit), matrix, height)
    blocks = callMLlibFunc("getMatrixBlocks", blocks._java_matrix_wrapper._java_model)
    blocks = blocks.select(F.col("_1._1").cast("long").alias("at"), F.col("_2").alias("m"))
    joined = numbered.join(blocks, F.col("no") == F.col("at")).select("ids", "n", "x", "m")
    rows = joined.mapInArrow(_apart(fit, varies), "id long, deviation long, whitened array<double>")
    return Whitened(rows, fit.n, [max(float(e), 0.0) / trace if trace else None for e in values], error, directions)


def _whitening_matrix(spark: SparkSession, w: np.ndarray) -> BlockMatrix:
    """``w`` as blocks of WIDTH rows: as large as a dimension, whatever the number of rows."""
    d, k = w.shape

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in column(batch, "id").to_pylist():
                yield _matrix_rows([{"_1": j, "_2": 0}], [np.ascontiguousarray(w[j * WIDTH : (j + 1) * WIDTH])])

    cuts = -(-d // WIDTH)
    return _as_matrix(spark.range(0, cuts, 1, 1).mapInArrow(made, _INDEXED), min(WIDTH, d), k, d, k)


def _projected(m: BlockMatrix, w: BlockMatrix, height: int) -> BlockMatrix:
    product = m._java_matrix_wrapper.call("multiply", w._java_matrix_wrapper._java_model)
    return BlockMatrix(product, height, w.colsPerBlock)


def _apart(fit: Fit, varies: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = column(batch, "m")
            for i in range(batch.num_rows):
                n = column(batch, "n")[i].as_py()
                one = m.slice(i, 1)
                high, wide, flip = (one.field(c)[0].as_py() for c in ("numRows", "numCols", "isTransposed"))
                values = one.field("values")[0].values.to_numpy()
                y = values.reshape(high, wide) if flip else values.reshape(wide, high).T
                y = y[:n]
                x = np.frombuffer(column(batch, "x")[i].as_py(), np.int64).reshape(n, fit.d)
                hidden = None if varies.all() else np.tile(~varies, n)
                flat = pa.array(np.ascontiguousarray(y).ravel(), mask=hidden)
                whitened = pa.ListArray.from_arrays(np.arange(0, n * wide + 1, wide, dtype=np.int32), flat)
                ids = column(batch, "ids")[i].values
                yield pa.record_batch([ids, fit.deviation(x), whitened], ["id", "deviation", "whitened"])

    return rows
