"""What the operators share: reading, lasting intermediate tables, and words of a batch of texts as numpy arrays.

A word is a run of bytes other than blank and \\x09-\\x0d, so a text never has to be decoded: the UTF-8 bytes of a whole
Arrow batch are one array, and words, lines, shingles and their hashes are computed for all its texts at once.
Hashes are 64 bits: prefix sums of random byte values times powers of an odd number, divided by the power at the start
(odd numbers have inverses modulo 2**64), then mixed.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, shuffles_removed

#: Bytes of text handled at once inside a task; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder as Parquet and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` returned, once all that is made of them is stored in its turn."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


def collector_paused(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` with Python's cycle collector off while a task makes many small objects, and as it was when the task ends: the
    worker goes on to other tasks. What the task leaves can then be collected, and Arrow's free memory goes back to the system."""

    @wraps(run)
    def paused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if was:
                gc.enable()
            pa.default_memory_pool().release_unused()

    return paused


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most SLICE_BYTES of text each, one row at least."""
    offsets = text_bytes(texts)[1]
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more entry than texts). Null is empty."""
    a = texts.cast(pa.large_binary()).fill_null(b"")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8) if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every bit of the input moves every bit of the result."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


@lru_cache(4)
def _byte_values(lower: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
    if lower:
        v[65:91] = v[97:123]
    return v


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) <= n:
        m = max(n + 1, SLICE_BYTES + 1)
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(m, base, _U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[0] = (both[0], both[1])
    return have


class Words:
    """Words of consecutive texts: ``start``, ``end`` (bytes), ``doc`` (text number), ``hash``; ``per_doc`` counts them."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool):
        self.raw, self.offsets, self.n_docs = raw, offsets, len(offsets) - 1
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        self.space = space
        inside = ~space
        first = inside.copy()
        if len(raw):
            first[1:] &= space[:-1]
            cuts = offsets[:-1][np.diff(offsets) > 0]
            first[cuts] = inside[cuts]
        self.start = np.flatnonzero(first)
        last = inside.copy()
        if len(raw):
            last[:-1] &= space[1:]
            ends = offsets[1:][np.diff(offsets) > 0] - 1
            last[ends] = inside[ends]
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.per_doc = np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)
        power, self._inverse = _powers(len(raw))
        self._sums = np.zeros(len(raw) + 1, _U)
        np.cumsum(_byte_values(lower)[raw] * power[: len(raw)], out=self._sums[1:])
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span."""
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(_U))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each k-word window and the number of its first word; windows do not cross texts."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        h = np.zeros(n, _U)
        for i in range(k):
            h = h * _U(_BASE) + self.hash[i : i + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return mix(h[at]), at


def blocks(texts: pa.Array, lower: bool) -> Iterator[tuple[int, int, Words]]:
    for lo, hi in text_slices(texts):
        raw, off = text_bytes(texts.slice(lo, hi - lo))
        yield lo, hi, Words(raw, off, lower)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
