"""Token counts by trie-shared dynamic programming, and SentencePiece N-best encoding and decoding.

Both walk the texts once, without a shuffle: a task cuts its texts into pre-tokens and puts those it has not met into a trie
(see ``lattice``); what it has learned it keeps, up to ``KEPT`` pre-tokens, for its next texts. Words of a text do not
interact, so a text's score is the sum over its pre-tokens, and its N best segmentations deviate from the best one only in the
N - 1 places where the second best costs least; those few words get an A* search for their own N best, and a heap puts the
combinations in order.

Defined results: null and empty texts consist of the blank put before every text, one pre-token; ids that a text cannot have
(fewer than N segmentations) are absent; U+2581 in a text counts as a blank; repeated rows are handled each; null ids
are carried; an empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lattice
from .common import collector_paused, column, text_slices

KEPT = 400_000
MASK = lattice.PIECE - 1


class Learned(dict):
    """Pre-token to a number, and by that number its best key, what the second best costs more, its ids and their length in bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.vocabulary = lattice.vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids: list[bytes] = []
        self.best, self.gap, self.length = (np.zeros(1024, np.int64) for _ in range(3))

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """All pre-tokens of the texts in a row, their numbers, and where each text's begin (one more entry than texts)."""
        split = [lattice.pre_tokens(t) for t in texts]
        flat = [w for words in split for w in words]
        if len(self) > KEPT:
            self.forget()
        new = sorted(set(flat).difference(self))
        at, more = len(self.ids), len(self.ids) + len(new)
        if more > len(self.best):
            self.best, self.gap, self.length = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.best, self.gap, self.length))
        got = self.vocabulary.segment([w.replace(" ", lattice.BLANK) for w in new])
        self.update(zip(new, range(at, more), strict=True))
        self.ids += [g[2] for g in got]
        self.best[at:more] = [g[0] for g in got]
        self.gap[at:more] = [min(g[1], int(lattice.NEVER)) - g[0] for g in got]
        self.length[at:more] = [len(g[2]) for g in got]
        numbers = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        return flat, numbers, np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pre_tokens, n_tokens and cost (thousandths of a nat) of each text's best segmentation."""

    @collector_paused
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Learned(path)
        for b in batches:
            texts = column(b, "text")
            for lo, hi in text_slices(texts):
                _, numbers, at = known.texts(texts.slice(lo, hi - lo).to_pylist())
                keys = known.best[numbers]
                cols = [pa.array(np.diff(at)), pa.array(np.add.reduceat(keys & MASK, at[:-1])), pa.array(np.add.reduceat(keys >> 20, at[:-1]))]
                yield pa.RecordBatch.from_arrays([column(b, "doc_id").slice(lo, hi - lo), *cols], ["doc_id", "n_pre_tokens", "n_tokens", "cost"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_pre_tokens long, n_tokens long, cost long")


def combinations(deltas: list[list[int]], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The n cheapest choices of one alternative per place; ``deltas`` rise from 0 in each place. Ties: fewer, then earlier changes."""
    heap, seen, out = [(0, (0,) * len(deltas))], {(0,) * len(deltas)}, []
    while heap and len(out) < n:
        cost, choice = heapq.heappop(heap)
        out.append((cost, choice))
        for i, d in enumerate(deltas):
            if choice[i] + 1 < len(d):
                more = (*choice[:i], choice[i] + 1, *choice[i + 1 :])
                if more not in seen:
                    seen.add(more)
                    heapq.heappush(heap, (cost - d[choice[i]] + d[choice[i] + 1], more))
    return out


def segmentations(words: list[str], numbers: np.ndarray, known: Learned, n: int) -> list[tuple[tuple[int, int], bytes, list[tuple[str, bytes]]]]:
    """((cost, pieces), ids, changed words with their ids) of the n best segmentations of a text's pre-tokens."""
    keys = known.best[numbers]
    cost, count = int((keys >> 20).sum()), int((keys & MASK).sum())
    plain = b"".join(map(known.ids.__getitem__, numbers.tolist()))
    if n == 1:
        return [((cost, count), plain, [])]
    gaps, ends = known.gap[numbers], np.cumsum(known.length[numbers])
    places = np.argsort(gaps, kind="stable")[: n - 1] if len(gaps) <= n - 1 else _least(gaps, n - 1)
    places = sorted(places.tolist(), key=lambda i: (gaps[i], i))
    own = [known.vocabulary.n_best(words[i].replace(" ", lattice.BLANK), n) for i in places]
    out = []
    for _, choice in combinations([[k - x[0][0] for k, _ in x] for x in own], n):
        c, m, changed = cost, count, {}
        for i, x, j in zip(places, own, choice, strict=True):
            if j:
                c, m = c + (x[j][0] >> 20) - (x[0][0] >> 20), m + (x[j][0] & MASK) - (x[0][0] & MASK)
                changed[i] = np.array(x[j][1], np.uint32).tobytes()
        parts, at = [], 0
        for i in sorted(changed):
            end = int(ends[i])
            parts += [plain[at : end - len(known.ids[numbers[i]])], changed[i]]
            at = end
        out.append(((c, m), b"".join([*parts, plain[at:]]), [(words[i], ids) for i, ids in changed.items()]))
    return out


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least values, equal ones by place."""
    bound = np.partition(values, n - 1)[n - 1]
    at = np.flatnonzero(values <= bound)
    return at[np.argsort(values[at], kind="stable")[:n]]


def n_best(docs: DataFrame, path: str, n: int = 3, check: bool = False) -> DataFrame:
    """doc_id, rank (from 1), cost, n_pieces, ids (little-endian uint32); with ``check`` also whether they decode to the text."""
    fields = "doc_id long, rank int, cost long, n_pieces long, ids binary" + ", round_trip boolean" * check
    names = [f.split()[0] for f in fields.split(", ")]

    @collector_paused
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Learned(path)
        decoder = Decoder(known.vocabulary)
        for b in batches:
            texts = column(b, "text")
            for lo, hi in text_slices(texts):
                raw = texts.slice(lo, hi - lo).to_pylist()
                flat, numbers, at = known.texts(raw)
                rows: list[tuple] = []
                for doc, text, x, y in zip(column(b, "doc_id").slice(lo, hi - lo).to_pylist(), raw, at[:-1].tolist(), at[1:].tolist(), strict=True):
                    whole = True
                    for rank, ((cost, count), ids, changed) in enumerate(segmentations(flat[x:y], numbers[x:y], known, n), 1):
                        if check and rank == 1:
                            whole = decoder.text(ids) == (text or "").replace(lattice.BLANK, " ")
                        # the others differ from the first in the changed words alone
                        same = (whole and all(decoder.surfaces(i) == w for w, i in changed),) if check else ()
                        rows.append((doc, rank, cost, count, ids, *same))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, fields)


class Decoder:
    """Piece ids to text: surfaces in a row, byte pieces read as UTF-8 where they make characters."""

    def __init__(self, v: lattice.Vocabulary):
        self.surface = [p.replace(lattice.BLANK, " ").encode() for p in v.pieces]
        for byte, i in v.bytes.items():
            self.surface[i] = bytes([byte])

    def surfaces(self, ids: bytes) -> str:
        return b"".join(map(self.surface.__getitem__, np.frombuffer(ids, np.uint32).tolist())).decode("utf-8", "replace")

    def text(self, ids: bytes) -> str:
        return self.surfaces(ids)[1:]


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (any columns, with ids) and its ``decoded`` text. Null ids give null; the blank put first is dropped."""
    rest = encoded.drop("decoded")
    names = rest.columns
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lattice.vocabulary(path))
        for b in batches:
            texts = [None if x is None else decoder.text(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return rest.mapInArrow(run, T.StructType([*rest.schema, T.StructField("decoded", T.StringType())]))
