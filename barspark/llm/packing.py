"""Packing along a space-filling curve.

Each document's tokens are counted into a hashed vector and projected to a few dimensions (both linear, so one small table
of token id to projection does it). Dimensions are standardised over all documents and become coordinates of a Hilbert
curve; documents are range-sorted by (curve key, row) and the token stream along the curve is cut every ``length`` tokens.
Neighbours on the curve so share sequences, every sequence but the last is full, and no group grows: ties, copies and hot
sources are split like any other run. Positions come from sums per partition, so no task and no driver sees the stream.

Defined results: null and empty texts hold one token, the end token; a null ``doc_id`` is carried; repeated rows are
packed once each; an empty table gives an empty table. Columns of the input other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import collector_paused, column, mix, text_slices, written

DIMS, BITS, BUCKETS = 4, 10, 1024
END = 1


#: A word of plain letters and then marks: two pre-tokens at most, neither of which depends on the other. No apostrophes.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00de\u00df-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\\[-`{-~]*)")
#: Parts of words that show how a tokenizer splits and maps letters and marks: all ASCII ones occur.
PROBES = ["the", "quick", "brownfox", "jumpsoverlazydog", "zyxwvutsrqponmlkjihgfedcba", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", "...", "_", "]]>"]


class WordIds(dict):
    """Token ids of words as bytes, for tokenizers that lower case, never merge over white space and mark the ends of
    pre-tokens (the vocabulary's ``</w>``). Words mostly differ by case and by marks behind them, so their letters and their
    marks are encoded once each, many in one call, and told apart by the end marks."""

    def __init__(self, path: str, most: int = 500_000):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark fills the cores; small calls would pay for waking threads
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.by_word = bool(self.ends.any())
        #: whether ASCII letters, or marks, go to the model as they are: then it alone encodes them
        self.direct = self.by_word and all(self._model_ids(x) == self.tokenizer.encode(x, add_special_tokens=False).ids for x in PROBES)
        self.parts: dict[str, bytes] = {"": b""}

    def _model_ids(self, part: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(part)]

    def __missing__(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids, np.uint32).tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode the new ones of ``words``; words over 64 letters are not kept."""
        if len(self) > self.most:
            self.clear()
        if len(self.parts) > self.most:
            self.parts = {"": b""}
        plain, odd, parts = [], [], self.parts
        fresh: set[str] = set()
        for w in words.difference(self):
            if len(w) > 64:
                continue
            if m := PLAIN.fullmatch(w):
                letters, marks = m[1].lower(), m[2]
                plain.append((w, letters, marks))
                if letters not in parts:
                    fresh.add(letters)
                if marks not in parts:
                    fresh.add(marks)
            else:
                odd.append(w)
        if self.direct:
            own, flat, at = [x for x in fresh if x.isascii()], [], [0]
            tokenize = self.tokenizer.model.tokenize
            for x in own:
                flat += [t.id for t in tokenize(x)]
                at.append(4 * len(flat))
            raw = np.array(flat, np.uint32).tobytes()
            for x, lo, hi in zip(own, at[:-1], at[1:], strict=True):
                parts[x] = raw[lo:hi]
            fresh.difference_update(own)
        new = list(fresh)
        for i in range(0, len(new), 1000):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new[i : i + 1000])], add_special_tokens=False)[0].ids, np.uint32)
            raw, cut = ids.tobytes(), [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            for x, lo, hi in zip(new[i : i + 1000], cut[:-1], cut[1:], strict=True):
                parts[x] = raw[lo:hi]
        for w, letters, marks in plain:
            self[w] = parts[letters] + parts[marks]
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self[w] = np.array(e.ids, np.uint32).tobytes()


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_bytes(path: str, texts: list[str | None], end: int = END) -> list[bytes]:
    """Ids of each text and the end id, as little-endian unsigned 32-bit numbers. Splits at blanks and line feeds only."""
    ids, stop = word_ids(path), np.array([end], np.uint32).tobytes()
    if not ids.by_word:
        return [np.array(e.ids, np.uint32).tobytes() + stop for e in ids.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    split = [(t or "").replace("\n", " ").split(" ") for t in texts]
    ids.learn(set().union(*split))
    get = ids.__getitem__
    return [b"".join(map(get, words)) + stop for words in split]


@lru_cache(1)
def projection() -> np.ndarray:
    """Token id to its hashed bucket's row of a random sign matrix: hashing and projecting in one look-up (ids below 2**17; larger ones wrap)."""
    h = mix(np.arange(1 << 17, dtype=np.uint64) + np.uint64(11))
    sign = np.where(h >> np.uint64(63), 1, -1).astype(np.float32)
    signs = mix(np.arange(BUCKETS * DIMS, dtype=np.uint64) + np.uint64(101)).reshape(BUCKETS, DIMS) & np.uint64(1)
    return sign[:, None] * (signs[(h % np.uint64(BUCKETS)).astype(np.int64)].astype(np.float32) * 2 - 1)


def hilbert(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (Skilling's transform, all points at once)."""
    x = coordinates.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenised(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """row, doc_id, ids (little-endian uint32), n, and the projected vector's mean per token."""
    dims = [f"v{i}" for i in range(DIMS)]

    @collector_paused  # a million small strings and no cycles: the collector would only walk them
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = projection()
        for b in batches:
            texts = column(b, "text")
            for lo, hi in text_slices(texts):
                got = token_bytes(tokenizer, texts.slice(lo, hi - lo).to_pylist(), end)
                n = np.array([len(g) // 4 for g in got], np.int64)
                flat = np.frombuffer(b"".join(got), np.uint32)
                starts = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
                v = np.stack([np.add.reduceat(table[:, d][flat & 0x1FFFF], starts) / np.sqrt(n) for d in range(DIMS)])
                cols = [column(b, "row").slice(lo, hi - lo), column(b, "doc_id").slice(lo, hi - lo), pa.array(got, pa.binary()), pa.array(n), *(pa.array(x.astype(np.float64)) for x in v)]
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "ids", "n", *dims])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, ids binary, n long, " + ", ".join(f"{d} double" for d in dims))


def curve_keys(vectors: DataFrame) -> DataFrame:
    """row, n and Hilbert key. The scale of each dimension comes from all documents (eight sums)."""
    dims = [f"v{i}" for i in range(DIMS)]
    scale = vectors.agg(*[F.avg(d).alias(f"m{d}") for d in dims], *[F.stddev_pop(d).alias(f"s{d}") for d in dims]).first()
    mean = np.array([scale[f"m{d}"] or 0.0 for d in dims])
    dev = np.array([scale[f"s{d}"] or 1.0 for d in dims])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = (np.stack([column(b, d).to_numpy(zero_copy_only=False) for d in dims], axis=1) - mean) / dev
            # a logistic curve stands in for the normal one: even use of the grid's cells
            cell = np.clip((1 << BITS) / (1 + np.exp(-1.702 * z)), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([column(b, "row"), column(b, "n"), pa.array(hilbert(cell, BITS))], ["row", "n", "key"])

    return vectors.select("row", "n", *dims).mapInArrow(run, "row long, n long, key long")


def positions(keys: DataFrame) -> DataFrame:
    """row and the number of tokens before it along the curve."""
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.repartitionByRange(parts, "key", "row").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "curve")  # the cut points are drawn by sampling: fix them
    sums = ranged.groupBy("part").agg(F.sum("n").alias("total"))  # as many rows as partitions
    before = sums.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = Window.partitionBy("part").orderBy("key", "row")
    local = ranged.select("row", "part", (F.sum("n").over(inside) - F.col("n")).alias("local"))
    return local.join(F.broadcast(before), "part").select("row", (F.col("local") + F.col("before")).alias("position"))


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end: int = END) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset."""
    held = written(tokenised(docs, tokenizer, end), "tokens")
    where = positions(curve_keys(held))
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, p = (column(b, c).to_numpy() for c in ("n", "position"))
            first, last = p // length, (p + n - 1) // length
            count = last - first + 1
            doc = np.repeat(np.arange(b.num_rows), count)
            seq = np.repeat(first, count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            begin, stop = np.maximum(p[doc], seq * length), np.minimum((p + n)[doc], (seq + 1) * length)
            start, size = begin - p[doc], stop - begin
            raw = column(b, "ids")
            views = [memoryview(x.as_buffer()) for x in raw]
            for lo in range(0, len(doc), 4096):
                s = slice(lo, lo + 4096)
                ids = pa.array([bytes(views[d][4 * a : 4 * (a + k)]) for d, a, k in zip(doc[s].tolist(), start[s].tolist(), size[s].tolist(), strict=True)], pa.binary())
                cols = [column(b, "doc_id").take(pa.array(doc[s])), pa.array(start[s]), pa.array(size[s]), ids, pa.array(n[doc[s]]), pa.array(seq[s]), pa.array((begin - seq * length)[s])]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = held.select("row", "doc_id", "ids", "n").join(where, "row")
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids and piece lengths of each sequence; a sequence is bounded by its length."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.col("p.length").alias("lengths"))
