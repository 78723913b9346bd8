"""Brown class-based n-grams: exchange clustering, then smoothed class transitions and word emissions.

Tokens are lower-cased words and one end per document. Every word that occurs ``LEAST`` times or more is a clustering unit of
its own, however many there are. One task exchanges the most frequent words and spelling groups (a hash of the last three bytes)
that stand for all others, which is only the start: then every unit moves, one group after the other, by Spark jobs over the
unit bigrams of the whole training text to the class that raises the likelihood of the class bigram model most; a group's moves
stay only if together they raise it (else the better half of them is tried, then a quarter). Rarer words join the class that
their own neighbours fit best. Spelling decides for unknown words alone, and stands in for rare words as neighbours until they have a class.

P(text) = product of P(class | class before) P(word | class). Transitions are counts plus ``STRENGTH`` pseudo-counts shared
out by class frequency. Emissions are discounted counts (by n1 / (n1 + 2 n2), at most a half: texts near training texts hold
many words seen once); what the discount takes is the class's one unknown word.

Counts and classes of at most ``TABLE`` words of at most 64 bytes go out with the scoring pass; all rarer words are looked up by
a join before transitions are scored, so that every known word counts whatever the size of the vocabulary.

What a task holds does not grow with the vocabulary but for twelve bytes a unit and one of its class: words find their units by
hash, a group that moves has ``SHARE`` units at most (so that more units are more groups), and each group's bigrams are columns
of their own, so that a pass reads its group alone.

Defined results: null text is empty and holds only its end; a null ``doc_id`` trains (its text form is taken as empty); repeated
rows train and are scored each; without training rows every probability is that of an unknown word; an empty table gives an
empty table; other columns are not read. ``docs`` has to be a stored table.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, column, text_bytes, text_slices, written

OWN, SPELLED, CLASSES, PASSES = 1024, 1024, 48, 8
UNITS = OWN + SPELLED
#: Count from which a word is a unit; groups that move by turns, at least, and turns at most; units of a group at most.
LEAST, GROUPS, TURNS, SHARE = 32, 4, 3, 1 << 15
#: Entries of a stored row of bigrams; entries, or tokens, that a task works on at once; units in a row of sums.
ROW, STEP, BLOCK = 1024, 1 << 20, 16
RARE = 64
TABLE, STRENGTH = 1 << 17, 20.0
END = b""


def spelled(word: bytes) -> int:
    """Unit of a word that has none of its own."""
    return OWN + zlib.crc32(word[-3:]) % SPELLED


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Units:
    """Units of words by the hash of their bytes; a word that has none gets that of its spelling."""

    def __init__(self, own: dict[bytes, int]):
        words, hashes = [w for w in own if w], [np.zeros(0, np.uint64)]
        for lo in range(0, len(words), 4096):
            raw = np.frombuffer(b" ".join(words[lo : lo + 4096]), np.uint8)
            hashes.append(Words(raw, np.array([0, len(raw)]), True).hash)
        made = np.concatenate(hashes)
        order = np.argsort(made)
        self.unit = np.array([own[w] for w in words], np.int32)[order]
        self.hash = np.append(made[order], np.uint64(2**64 - 1))
        bits = max(1, len(words).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(made[order], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __call__(self, words: Words) -> np.ndarray:
        h = words.hash
        at = self.first[h >> self.shift]
        later = np.flatnonzero(self.hash[at] < h)
        while len(later):
            at[later] += 1
            later = later[self.hash[at[later]] < h[later]]
        units = np.append(self.unit, np.int32(-1))[at]
        other = np.flatnonzero((self.hash[at] != h) | (units < 0))
        start, end = words.start[other], words.end[other]
        crc = np.full(len(other), 0xFFFFFFFF, np.uint32)
        for back in (3, 2, 1):
            has = np.flatnonzero(end - back >= start)
            crc[has] = CRC[(crc[has] ^ LOWER[words.raw[end[has] - back]]) & np.uint32(255)] ^ (crc[has] >> np.uint32(8))
        units[other] = OWN + (~crc % np.uint32(SPELLED)).astype(np.int32)
        return units


def _strings(words: Words, which: np.ndarray) -> pa.Array:
    """The words of these numbers, lower-cased."""
    start, size = words.start[which], words.end[which] - words.start[which]
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = LOWER[words.raw[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]]
    return pa.Array.from_buffers(pa.string(), len(which), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _spelled_column(word: Column) -> Column:
    return (F.lit(OWN) + F.crc32(F.substring(F.encode(word, "utf-8"), -3, 3)) % SPELLED).cast("int")


def _flat_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in a row and each text's number of words."""
    split = [(t or b"").lower().split() for t in texts.cast(pa.large_binary()).to_pylist()]
    return [w for words in split for w in words], np.array([len(s) for s in split], np.int64)


def vocabulary(train: DataFrame) -> DataFrame:
    """word ("" is the end) and its count c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for b in batches:
            for lo, hi in text_slices(column(b, "text")):
                words, n = _flat_words(column(b, "text").slice(lo, hi - lo))
                counts.update(words)
                counts[END] += len(n)
            if len(counts) > 400_000:
                yield out()
                counts = Counter()
        yield out()

    return train.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(words: DataFrame, most: int) -> list[tuple[str, int, int]]:
    """Words of high count, at most ``most``: all above a bound that a histogram of counts gives, with count and class. Longer than 64 bytes: not."""
    short = words.filter("octet_length(word) <= 64 AND word <> ''")
    step = F.floor(F.log2("c") * 16).cast("int")
    sizes = sorted(((r["s"], r["count"]) for r in short.groupBy(step.alias("s")).count().collect()), reverse=True)
    bound, total = None, 0
    for s, n in sizes:
        total += n
        if total > most:
            break
        bound = s
    if bound is None:
        return []
    got = short.filter(step >= bound).select("word", "c", "k").toPandas()
    return sorted(zip(got["word"], got["c"].tolist(), got["k"].tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def numbered(words: DataFrame) -> dict[bytes, int]:
    """Unit of every word of ``LEAST`` occurrences or more; the end is 0. Numbers from OWN to UNITS are the spelling groups'."""
    got = words.filter((F.col("c") >= LEAST) & (F.col("word") != "")).toPandas()
    top = sorted(zip(got["word"], got["c"].tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return {END: 0} | {w.encode(): i + 1 if i + 1 < OWN else UNITS + i + 1 - OWN for i, (w, _) in enumerate(top)}


def unit_bigrams(train: DataFrame, own: dict[bytes, int]) -> DataFrame:
    """Columns u0, o0, u1, ... of packed numbers. Each bigram stands in its first unit's group and in its second's: u is twice the
    unit's number in its group, plus one where it comes second, and o the other unit. An end stands before the first word."""
    groups = max(GROUPS, -(-(UNITS + max(0, len(own) - OWN)) // SHARE))
    spread = train.sparkSession.sparkContext.broadcast(Units(own))
    names = [f"{c}{g}" for g in range(groups) for c in "uo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, words in blocks(column(b, "text"), True):
                second = _with_ends(spread.value(words), words.per_doc, 0)
                first = np.append(np.int32(0), second[:-1])
                inner = np.flatnonzero(second)  # the end never moves: what comes before it is not asked for
                unit, other = np.concatenate([first, second[inner]]), np.concatenate([second, first[inner]])
                twice = unit // groups * 2
                twice[len(first) :] += 1
                group = (unit % groups).astype(np.uint16)
                order, sizes = np.argsort(group, kind="stable"), np.bincount(group, minlength=groups)
                u, o, n, lo, cols = twice[order].astype(np.uint16), other[order].astype(np.int32), -(-int(sizes.max()) // ROW), 0, []
                for size in sizes.tolist():
                    cuts = np.arange(n + 1) * size // n
                    for x in (u, o):
                        part = np.ascontiguousarray(x[lo : lo + size])
                        cols.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(part)]))
                    lo += size
                yield pa.RecordBatch.from_arrays(cols, names)

    return train.select("text").mapInArrow(run, ", ".join(f"{c} binary" for c in names))


def _few_tasks(bigrams: DataFrame) -> DataFrame:
    """Two tasks a core, whatever the number of files: each holds, and hands on, sums for a whole group of units."""
    return bigrams.coalesce(2 * bigrams.sparkSession.sparkContext.defaultParallelism)


def _group(bigrams: DataFrame, group: int) -> DataFrame:
    return bigrams.select(F.lit(group).alias("g"), F.col(f"u{group}").alias("u"), F.col(f"o{group}").alias("o"))


def _n_groups(bigrams: DataFrame) -> int:
    return len(bigrams.columns) // 2


def _every(bigrams: DataFrame) -> DataFrame:
    """All groups below each other, so that a task reads one group's columns at a time."""
    return reduce(DataFrame.unionAll, [_group(bigrams, g) for g in range(_n_groups(bigrams))])


def _entries(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Twice the number in the group (plus one), unit and other unit, some entries at a time."""
    for batch in batches:
        of = column(batch, "g").to_numpy()
        for g in np.unique(of).tolist():
            some = batch if (of == g).all() else batch.filter(pa.array(of == g))
            u, o = text_bytes(column(some, "u"))[0].view(np.uint16), text_bytes(column(some, "o"))[0].view(np.int32)
            for lo in range(0, len(u), STEP):
                at = u[lo : lo + STEP].astype(np.int32)
                yield at, at // 2 * groups + g, o[lo : lo + STEP]


def _bigrams_of(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First and second unit of every bigram, once."""
    for at, unit, other in _entries(batches, groups):
        first = np.flatnonzero(at % 2 == 0)
        yield unit[first], other[first]


def _offsets(text_of: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.searchsorted(text_of, np.arange(n + 1)).astype(np.int32))


def _with_ends(values: np.ndarray, per_text: np.ndarray, end) -> np.ndarray:
    """``values`` with ``end`` behind each text's own."""
    return np.insert(values, np.cumsum(per_text), end)


def _xlogx(x: np.ndarray) -> np.ndarray:
    t = np.maximum(x, 1.0)
    np.log(t, out=t)
    t *= x
    return t


def best_classes(now: np.ndarray, left: np.ndarray, right: np.ndarray, self_pairs: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best class for each of some units and the gain in sum(G log G) - sum(rows) - sum(columns) over staying, each moved alone.

    left[i, c]: class c before unit i, right[i, c]: after it, both without the unit's pairs with itself.
    """
    i, own = np.arange(len(now)), self_pairs[:, None]
    f = np.repeat(_xlogx(g)[None], len(now), axis=0)
    g = np.repeat(g[None], len(now), axis=0)
    g[i, now] -= right
    g[i, :, now] -= left
    g[i, now, now] -= self_pairs
    f[i, now], f[i, :, now] = _xlogx(g[i, now]), _xlogx(g[i, :, now])
    rows, cols = g.sum(axis=2) + left, g.sum(axis=1) + right  # wherever the unit goes, its neighbours' totals hold it
    by_row = (_xlogx(g + right[:, None]) - f).sum(axis=2)
    by_col = (_xlogx(g + left[:, :, None]) - f).sum(axis=1)
    d, same = np.diagonal(g, axis1=1, axis2=2), np.diagonal(f, axis1=1, axis2=2)
    corner = _xlogx(d + right + left + own) - _xlogx(d + right) - _xlogx(d + left) + same
    out, into = right.sum(axis=1, keepdims=True) + own, left.sum(axis=1, keepdims=True) + own
    value = by_row + by_col + corner - (_xlogx(rows + out) - _xlogx(rows)) - (_xlogx(cols + into) - _xlogx(cols))
    value[:, 0] = -np.inf  # the end's own class
    best = value.argmax(axis=1)
    return best, value[i, best] - value[i, now]


def best_class(now: int, left: np.ndarray, right: np.ndarray, self_pairs: float, g: np.ndarray) -> tuple[int, float]:
    """:func:`best_classes` of one unit."""
    best, gain = best_classes(np.array([now]), left[None], right[None], np.array([self_pairs]), g)
    return int(best[0]), float(gain[0])


def exchange_passes(pairs: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit and the class bigram counts. Units start in classes dealt out in order; each pass offers every unit in
    turn its best class, until few move."""
    n = len(pairs)
    classes = np.concatenate([[0], np.arange(n - 1) % (CLASSES - 1) + 1])
    member = np.eye(CLASSES)[classes]
    left, right, own = pairs.T @ member, pairs @ member, np.diag(pairs)
    g = member.T @ right
    seen = np.flatnonzero((pairs.sum(axis=0) + pairs.sum(axis=1)) > 0)
    for _ in range(passes):
        moves = 0
        for u in seen[seen > 0].tolist():
            old, before, after = int(classes[u]), left[u].copy(), right[u].copy()
            before[old] -= own[u]
            after[old] -= own[u]
            new, gain = best_class(old, before, after, float(own[u]), g)
            if new == old or gain <= 1e-6:
                continue
            for k, sign in ((old, -1), (new, 1)):
                g[k] += sign * after
                g[:, k] += sign * before
                g[k, k] += sign * own[u]
                left[:, k] += sign * pairs[u]
                right[:, k] += sign * pairs[:, u]
            classes[u] = new
            moves += 1
        if moves <= n // 200:
            break
    return classes, g


def start(bigrams: DataFrame, own: dict[bytes, int]) -> np.ndarray:
    """First classes of all units, by exchange of OWN words and the spelling groups: at most UNITS**2 sums reach its one task."""
    fold = np.arange(UNITS + max(0, len(own) - OWN))
    for w, u in own.items():
        if u >= UNITS:
            fold[u] = spelled(w)
    spread, groups = bigrams.sparkSession.sparkContext.broadcast(fold.astype(np.int32)), _n_groups(bigrams)

    def rows(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for u in np.flatnonzero(sums.any(axis=1)).tolist():
            at = np.flatnonzero(sums[u])
            yield pa.RecordBatch.from_arrays([pa.array([u], pa.int32()), pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([sums[u, at].tolist()], pa.list_(pa.float64()))], ["u", "b", "n"])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, sums = spread.value, np.zeros(UNITS * UNITS)
        for a, b in _bigrams_of(batches, groups):
            np.add.at(sums, to[a] * UNITS + to[b], 1.0)
        yield from rows(sums.reshape(UNITS, UNITS))

    def table(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros((UNITS, UNITS))
        for batch in batches:
            for u, b, n in zip(column(batch, "u").to_pylist(), column(batch, "b"), column(batch, "n"), strict=True):
                sums[u, b.values.to_numpy()] += n.values.to_numpy()
        return sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, _ = exchange_passes(table(batches))
        yield pa.RecordBatch.from_arrays([pa.array([classes.tolist()], pa.list_(pa.int32()))], ["k"])

    schema = "u int, b array<int>, n array<double>"
    merged = _few_tasks(_every(bigrams)).mapInArrow(folded, schema).repartition(16, "u").mapInArrow(lambda x: rows(table(x)), schema)
    got = merged.repartition(1).mapInArrow(run, "k array<int>").first()
    classes = np.array(got["k"]) if got else exchange_passes(np.zeros((UNITS, UNITS)))[0]
    return classes[fold]


def _added(parts: list) -> np.ndarray:
    g = np.sum([r["g"] for r in parts], axis=0) if parts else np.zeros(CLASSES * CLASSES)
    return np.asarray(g, np.float64).reshape(CLASSES, CLASSES)


def class_bigrams(bigrams: DataFrame, classes: np.ndarray, spelling: bool = True) -> np.ndarray:
    """How often a class follows a class; without ``spelling``, between words that are units only."""
    spread, groups = bigrams.sparkSession.sparkContext.broadcast(classes.astype(np.int8)), _n_groups(bigrams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, g = spread.value, np.zeros(CLASSES * CLASSES, np.int64)
        for a, b in _bigrams_of(batches, groups):
            if not spelling:
                at = np.flatnonzero(((a < OWN) | (a >= UNITS)) & ((b < OWN) | (b >= UNITS)))
                a, b = a[at], b[at]
            g += np.bincount(k[a].astype(np.int32) * CLASSES + k[b], minlength=len(g))
        yield pa.RecordBatch.from_arrays([pa.array([g.tolist()], pa.list_(pa.int64()))], ["g"])

    return _added(_few_tasks(_every(bigrams)).mapInArrow(run, "g array<long>").collect())


def moved_bigrams(bigrams: DataFrame, classes: np.ndarray, trial: np.ndarray, group: int) -> np.ndarray:
    """What :func:`class_bigrams` gains and loses where units of one group alone have other classes in ``trial``."""
    spread, groups = bigrams.sparkSession.sparkContext.broadcast((classes.astype(np.int8), trial.astype(np.int8))), _n_groups(bigrams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (k, t), g = spread.value, np.zeros(CLASSES * CLASSES, np.int64)
        moves = k != t
        for at, unit, other in _entries(batches, groups):
            # a bigram whose units both move counts where its first one stands
            some = np.flatnonzero(moves[unit] & ((at % 2 == 0) | ~moves[other]))
            unit, other, back = unit[some], other[some], at[some] % 2 == 1
            a, b = np.where(back, other, unit), np.where(back, unit, other)
            g += np.bincount(t[a].astype(np.int32) * CLASSES + t[b], minlength=len(g))
            g -= np.bincount(k[a].astype(np.int32) * CLASSES + k[b], minlength=len(g))
        yield pa.RecordBatch.from_arrays([pa.array([g.tolist()], pa.list_(pa.int64()))], ["g"])

    return _added(_few_tasks(_group(bigrams, group)).mapInArrow(run, "g array<long>").collect())


def likelihood(g: np.ndarray) -> float:
    return float(_xlogx(g).sum() - _xlogx(g.sum(axis=0)).sum() - _xlogx(g.sum(axis=1)).sum())


def offers(bigrams: DataFrame, classes: np.ndarray, g: np.ndarray, group: int):
    """u, k, gain of the units of a group that would rather be in class k, greatest gain first."""
    groups, wide = _n_groups(bigrams), 2 * CLASSES + 1
    spread, size = bigrams.sparkSession.sparkContext.broadcast((classes.astype(np.int8), g)), -(-len(classes) // groups // BLOCK) * BLOCK

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, _ = spread.value
        after, twice = np.zeros(2 * size * CLASSES, np.int32), np.zeros(size, np.int32)
        for at, unit, other in _entries(batches, groups):
            np.add.at(after, at * CLASSES + k[other], np.int32(1))
            np.add.at(twice, at[(at % 2 == 0) & (unit == other)] // 2, np.int32(1))
        sides = after.reshape(size // BLOCK, BLOCK, 2 * CLASSES)
        for i in np.flatnonzero(sides.any(axis=(1, 2))).tolist():
            x = np.concatenate([sides[i], twice[i * BLOCK : i * BLOCK + BLOCK, None]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["block", "x"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, g = spread.value
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(column(batch, "block").to_pylist(), column(batch, "x"), strict=True):
                totals[i] = totals.get(i, 0) + np.frombuffer(x.as_buffer(), np.int32).astype(np.float64).reshape(BLOCK, wide)
        out = []
        for i, rows in totals.items():
            seen = np.flatnonzero(rows.any(axis=1))
            u = (i * BLOCK + seen) * groups + group
            after, before, own, now = rows[seen, :CLASSES], rows[seen, CLASSES:-1], rows[seen, -1], k[u].astype(np.int64)
            at = np.arange(len(seen))
            before[at, now] -= own
            after[at, now] -= own
            new, gain = best_classes(now, before, after, own, g)
            would = np.flatnonzero((u > 0) & (new != now) & (gain > 1e-6))
            out += zip(u[would].tolist(), new[would].tolist(), gain[would].tolist(), strict=True)
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["u", "k", "gain"])

    got = _few_tasks(_group(bigrams, group)).mapInArrow(sums, "block int, x binary").repartition("block").mapInArrow(best, "u int, k int, gain double")
    return got.toPandas().sort_values(["gain", "u"], ascending=[False, True])


def exchange(bigrams: DataFrame, own: dict[bytes, int]) -> np.ndarray:
    """Class of each unit."""
    classes = start(bigrams, own)
    g = class_bigrams(bigrams, classes)
    for _ in range(TURNS):
        moved = 0
        for group in range(_n_groups(bigrams)):
            got = offers(bigrams, classes, g, group)
            for part in (1, 2, 4):
                some = got.head(len(got) // part)
                if not len(some):
                    break
                trial = classes.copy()
                trial[some["u"].to_numpy()] = some["k"].to_numpy()
                h = g + moved_bigrams(bigrams, classes, trial, group)
                if likelihood(h) > likelihood(g):
                    classes, g, moved = trial, h, moved + len(some)
                    break
        if moved <= len(classes) // 200:
            break
    return classes


def rare_words(train: DataFrame, own: dict[bytes, int], classes: np.ndarray) -> DataFrame:
    """word, code, next: each occurrence of a word that is no unit, the classes on its sides (left * 128 + right; a side that is
    such a word too has its spelling's class plus RARE) and that word, if it follows."""
    spread = train.sparkSession.sparkContext.broadcast((Units(own), classes.astype(np.int8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit_of, classes = spread.value
        for b in batches:
            for _, _, words in blocks(column(b, "text"), True):
                units = _with_ends(unit_of(words), words.per_doc, 0)
                rare = (units >= OWN) & (units < UNITS)
                kinds = np.concatenate([[0], classes[units].astype(np.int32) + RARE * rare])
                at = np.flatnonzero(rare)
                mine = _strings(words, np.flatnonzero(np.delete(rare, np.cumsum(words.per_doc + 1) - 1)))
                follows = pa.array(np.arange(1, len(at) + 1), pa.int64(), mask=~rare[at + 1])  # an end is behind every word
                code = (kinds[at] * 128 + kinds[at + 2]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([mine, pa.array(code), mine.take(follows)], ["word", "code", "next"])

    return train.select("text").mapInArrow(run, "word string, code int, next string")


def join_classes(met: DataFrame, g: np.ndarray) -> DataFrame:
    """word, k, codes: the class whose bigrams fit a rare word's neighbours best; such a word has fewer than LEAST occurrences."""
    fit = np.log(g + 0.5) - np.log(g.sum(axis=1, keepdims=True) + CLASSES / 2) - np.log(g.sum(axis=0, keepdims=True) + CLASSES / 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = column(b, "codes").flatten().to_numpy()
            of = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(column(b, "codes")).to_numpy())
            left, right = (np.bincount(of * CLASSES + side, minlength=b.num_rows * CLASSES).reshape(-1, CLASSES) for side in (codes // 128 % RARE, codes % RARE))
            value = left @ fit + right @ fit.T
            value[:, 0] = -np.inf
            yield pa.RecordBatch.from_arrays([column(b, "word"), pa.array(value.argmax(axis=1).astype(np.int32)), column(b, "codes")], ["word", "k", "codes"])

    return met.groupBy("word").agg(F.collect_list("code").alias("codes")).mapInArrow(run, "word string, k int, codes array<int>")


def rare_bigrams(met: DataFrame, rare: DataFrame) -> np.ndarray:
    """Class bigrams with a rare word on one side or both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros(CLASSES * CLASSES)
        for b in batches:
            codes = column(b, "codes").flatten().to_numpy()
            k = np.repeat(column(b, "k").to_numpy(), pa.compute.list_value_length(column(b, "codes")).to_numpy())
            left, right = codes // 128, codes % 128
            g += np.bincount((left * CLASSES + k)[left < RARE], minlength=len(g)) + np.bincount((k * CLASSES + right)[right < RARE], minlength=len(g))
        yield pa.RecordBatch.from_arrays([pa.array([g.tolist()], pa.list_(pa.float64()))], ["g"])

    parts = [r["g"] for r in rare.select("k", "codes").mapInArrow(run, "g array<double>").collect()]
    g = np.sum(parts, axis=0).reshape(CLASSES, CLASSES) if parts else np.zeros((CLASSES, CLASSES))
    pairs = met.filter("next IS NOT NULL").groupBy("word", "next").agg(F.count("*").alias("n"))
    first = pairs.join(rare.select("word", F.col("k").alias("a")), "word").groupBy("next", "a").agg(F.sum("n").alias("n"))
    for r in first.join(rare.select(F.col("word").alias("next"), F.col("k").alias("b")), "next").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        g[r["a"], r["b"]] += r["n"]
    return g


class Model:
    """What scoring needs besides the rare words: bounded tables."""

    def __init__(self, words: list[tuple[str, int]], n_end: int, kinds: list[int], classes: np.ndarray, g: np.ndarray, tokens: float, types: float, per_class: dict[int, tuple[float, float]], discount: float):
        n_k = np.array([per_class.get(k, (0.0, 0.0))[0] for k in range(CLASSES)])
        v_k = np.array([per_class.get(k, (0.0, 0.0))[1] for k in range(CLASSES)])
        prior = (n_k + 1) / (n_k.sum() + CLASSES)
        self.move = np.log10((g + STRENGTH * prior) / (g.sum(axis=1, keepdims=True) + STRENGTH))
        self.scale = np.log10(n_k + 0.5)
        self.unknown = np.log10(discount * v_k + 0.5)
        self.index = {w.encode(): i + 1 for i, (w, _) in enumerate(words)}
        count = np.array([n_end, *(c for _, c in words)], np.float64)
        self.base = np.log10(count + 0.5)
        self.emit = np.log10(np.maximum(count - discount, 0.5))
        self.classes, self.of_spelling = np.array([0, *kinds]), classes[OWN:UNITS]
        self.discount, self.total, self.end_known = discount, math.log10(tokens + 0.5 * (types + 1)), n_end > 0


def _few_tokens(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of ``batch`` with at most STEP tokens together, one row at least."""
    ends, lo = np.cumsum(pa.compute.list_value_length(column(batch, "kinds")).to_numpy().astype(np.int64)), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def score(docs: DataFrame, training: Column) -> DataFrame:
    """row, doc_id, n_tokens, n_known, train_tokens, base_score, score of every document; ``training`` says which ones teach."""
    spark = docs.sparkSession
    train = docs.filter(training)
    words = written(vocabulary(train), "vocabulary")
    end = words.filter("word = ''").agg(F.sum("c")).first()[0] or 0
    own = numbered(words)
    bigrams = written(unit_bigrams(train, own), "bigrams")
    classes = exchange(bigrams, own)
    met = written(rare_words(train, own, classes), "rare")
    rare = written(join_classes(met, class_bigrams(bigrams, classes)), "joined")
    g = class_bigrams(bigrams, classes, spelling=False) + rare_bigrams(met, rare)
    unit_rows = spark.createDataFrame(pd.DataFrame({"word": [w.decode() for w in own], "k": classes[list(own.values())].astype(np.int32)}), "word string, k int")
    words = written(words.join(unit_rows.unionByName(rare.select("word", "k")), "word"), "classed")
    top = frequent(words, TABLE)
    sums = words.groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2")).collect()
    n1, n2 = sum(r["n1"] for r in sums), sum(r["n2"] for r in sums)
    discount = min(0.5, n1 / (n1 + 2 * n2)) if n1 else 0.5
    tokens, types = sum(r["n"] for r in sums), sum(r["v"] for r in sums)
    model = spark.sparkContext.broadcast(Model([(w, c) for w, c, _ in top], end, [k for *_, k in top], classes, g, tokens, types, {r["k"]: (r["n"], r["v"]) for r in sums}, discount))
    numbers = ["n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for lo, hi in text_slices(column(b, "text")):
                flat, per_text = _flat_words(column(b, "text").slice(lo, hi - lo))
                index = np.fromiter(map(m.index.get, flat, repeat(-1)), np.int64, len(flat))
                rare = np.flatnonzero(index < 0)
                kind = m.classes[np.maximum(index, 0)]
                base = np.where(index < 0, -m.total, m.base[np.maximum(index, 0)] - m.total)
                emit = np.where(index < 0, 0.0, m.emit[np.maximum(index, 0)] - m.scale[kind])
                kind[rare] = -1
                emits = _with_ends(emit, per_text, (m.emit[0] if m.end_known else m.unknown[0]) - m.scale[0])
                bases = _with_ends(base, per_text, m.base[0] - m.total)
                starts = np.concatenate([[0], np.cumsum(per_text + 1)[:-1]])
                known = np.add.reduceat(_with_ends((index >= 0).astype(np.int64), per_text, int(m.end_known)), starts)
                text_of = np.repeat(np.arange(hi - lo), per_text)
                kinds = pa.ListArray.from_arrays(_offsets(text_of, hi - lo), pa.array(kind.astype(np.int8)))
                lists = pa.ListArray.from_arrays(_offsets(text_of[rare], hi - lo), pa.array([flat[i] for i in rare.tolist()], pa.binary()).cast(pa.string()))
                cols = [pa.array(per_text + 1), pa.array(known), pa.array(np.add.reduceat(bases, starts)), pa.array(np.add.reduceat(emits, starts))]
                yield pa.RecordBatch.from_arrays([*(column(b, c).slice(lo, hi - lo) for c in ("row", "doc_id")), *cols, kinds, lists], ["row", "doc_id", *numbers, "kinds", "rare"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in (some for batch in batches for some in _few_tokens(batch)):
            per_text = pa.compute.list_value_length(column(b, "kinds")).to_numpy().astype(np.int64)
            found, kind = column(b, "found").flatten(), column(b, "kinds").flatten().to_numpy().astype(np.int64)
            rare = np.flatnonzero(kind < 0)
            k, c = (found.field(i).to_numpy() for i in (1, 2))
            kind[rare] = k = np.where(k < 0, m.of_spelling[np.maximum(-k - 1, 0)], k)
            emit, base, known = np.zeros(len(kind)), np.zeros(len(kind)), np.zeros(len(kind), np.int64)
            emit[rare] = np.where(c > 0, np.log10(np.maximum(c - m.discount, 0.5)), m.unknown[k]) - m.scale[k]
            base[rare], known[rare] = np.log10(c + 0.5), c > 0
            kinds = _with_ends(kind, per_text, 0)
            moves = m.move[np.concatenate([[0], kinds[:-1]]), kinds]
            starts = np.concatenate([[0], np.cumsum(per_text + 1)[:-1]])
            more = [np.zeros(b.num_rows, np.int64), np.add.reduceat(_with_ends(known, per_text, 0), starts), np.add.reduceat(_with_ends(base, per_text, 0.0), starts), np.add.reduceat(_with_ends(emit, per_text, 0.0) + moves, starts)]
            yield pa.RecordBatch.from_arrays([column(b, "row"), column(b, "doc_id"), *(pa.array(column(b, c).to_numpy() + x) for c, x in zip(numbers, more, strict=True))], ["row", "doc_id", *numbers])

    schema = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = written(rows.mapInArrow(run, schema + ", kinds array<tinyint>, rare array<string>"), "scored")
    # classes and counts of rare words by a join with the vocabulary; an unknown word has the number of its spelling, below 0
    each = held.select("row", F.posexplode("rare").alias("i", "word"))
    unknown = OWN - 1 - _spelled_column(F.col("word"))
    met = each.join(words, "word", "left").select("row", F.struct("i", F.coalesce("k", unknown).alias("k"), F.coalesce("c", F.lit(0)).alias("c")).alias("x"))
    lists = met.groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("found"))
    both = held.drop("rare").join(lists, "row", "left").withColumn("found", F.coalesce("found", F.from_json(F.lit("[]"), "array<struct<i:int,k:int,c:bigint>>")))
    out = both.mapInArrow(finish, schema)
    return out.withColumn("train_tokens", F.lit(int(tokens)).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
