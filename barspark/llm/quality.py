"""Quality rules: gradient-boosted trees over document statistics, flattened into node arrays.

``text_statistics`` turns an Arrow batch of texts into counts by numpy. ``fit`` grows depth-limited logistic trees on binned
features; a feature with direction -1 (or +1) may only lower (raise) the score as it grows, which holds because splits that
break the order are refused and children are kept within the bounds that their ancestors' splits set. ``quality_rules``
scores all documents in one pass without a shuffle: the model is a few kilobytes.

Labels: at most ``sample`` (default 20,000) labelled rows, those of lowest hash, train the model; a fifth of them sets the
threshold so that at most one good row in a thousand falls below it, and never above 1/2. Everything else covers all rows.

Defined results: null or empty text has no words and fails the base rule; a null ``doc_id`` is passed on; repeated rows are
judged alike, each by itself; without labels of both kinds the base rule decides alone; an empty table gives an empty table.
Input columns named like a result are replaced, other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, blocks, column, mix

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and the direction in which each may move the score (0: either).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0,
    "digit_share": 0, "mark_share": 0, "distinct_share": 0, "words_per_line": 0, "bar_share": -1, "bang_share": -1,
}
_BYTE_CLASSES = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)), "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "mark": np.isin(np.arange(256), np.frombuffer(b".,;:?!\"'()-", np.uint8)), "bar": np.arange(256) == 124, "bang": np.arange(256) == 33,
}


def _by_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _keyed(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1)))


def _statistics(w: Words) -> dict[str, np.ndarray]:
    raw, off, n = w.raw, w.offsets, w.n_docs
    out = {"n_words": w.per_doc}
    out["word_chars"] = _by_doc(~w.space & ((raw & 0xC0) != 0x80), off)
    out["n_symbols"] = _by_doc(SYMBOLS[raw], off)
    out |= {k: _by_doc(v[raw], off) for k, v in _BYTE_CLASSES.items()}
    # lines: from a text's start or after a line feed, to the next line feed or the text's end
    cuts = np.flatnonzero(raw == 10)
    full = np.diff(off) > 0
    begin = np.sort(np.concatenate([off[:-1][full], cuts + 1]))
    end = np.sort(np.concatenate([off[1:][full], cuts]))
    words_to = np.searchsorted(w.start, np.concatenate([begin, end]))
    worded = words_to[len(begin) :] > words_to[: len(begin)]
    begin, end = begin[worded], end[worded]
    doc = np.searchsorted(off, begin, side="right") - 1
    out["n_lines"] = np.bincount(doc, minlength=n)
    _, one = np.unique(_keyed(w.span_hash(begin, end), doc), return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(doc[one], minlength=n)
    # words covered by a 5-word window that its text holds twice
    h, at = w.windows(5)
    cover = np.zeros(len(w.hash) + 1, np.int64)
    if len(h):
        key = _keyed(h, w.doc[at])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + 5, -1)
    out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    _, one = np.unique(_keyed(w.hash, w.doc), return_index=True)
    out["n_distinct"] = np.bincount(w.doc[one], minlength=n)
    return out


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text, as int64 arrays."""
    parts = [_statistics(w) for _, _, w in blocks(texts, lower=False)]
    names = parts[0] if parts else [*COUNTS, "n_lines", "n_distinct", *_BYTE_CLASSES]
    return {k: np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in names}


def features_of(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines = (np.maximum(s[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    cols = (
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words,
        s["upper"] / chars, s["digit"] / chars, s["mark"] / chars, s["n_distinct"] / words, s["n_words"] / lines, s["bar"] / chars, s["bang"] / chars,
    )
    return np.stack([c.astype(np.float64) for c in cols], axis=1) if len(s["n_words"]) else np.zeros((0, len(FEATURES)))


@dataclass
class Trees:
    """All trees in one set of arrays; a leaf points to itself. ``roots`` holds each tree's first node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int
    threshold: float = 0.5

    def probability(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] > self.cut[node], self.right[node], self.left[node])
            score += self.value[node]
        return 1 / (1 + np.exp(-score))


def fit(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 5.0) -> Trees:
    """Newton boosting of the logistic loss on histograms."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score = np.full(len(y), base)
    nodes: list[list] = []
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)

        def leaf(rows, low, high):
            return float(np.clip(grad[rows].sum() / (hess[rows].sum() + ridge), low, high))

        def grow(rows, level, low, high):
            at = len(nodes)
            value = leaf(rows, low, high)
            nodes.append([0, np.inf, at, at, rate * value])
            best = None
            if level < depth and len(rows) >= 20:
                g_all, h_all = grad[rows].sum(), hess[rows].sum()
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    g = np.cumsum(np.bincount(binned[rows, f], grad[rows], len(c) + 1))[:-1]
                    h = np.cumsum(np.bincount(binned[rows, f], hess[rows], len(c) + 1))[:-1]
                    vl = np.clip(g / (h + ridge), low, high)
                    vr = np.clip((g_all - g) / (h_all - h + ridge), low, high)
                    # loss drop of a leaf of value v: g v - (h + ridge) v^2 / 2
                    gain = g * vl - (h + ridge) * vl**2 / 2 + (g_all - g) * vr - (h_all - h + ridge) * vr**2 / 2
                    if directions[f]:
                        gain = np.where((vr - vl) * directions[f] >= 0, gain, -np.inf)
                    i = int(np.argmax(gain))
                    if best is None or gain[i] > best[0]:
                        best = (gain[i], f, i, vl[i], vr[i])
                own = g_all * value - (h_all + ridge) * value**2 / 2
                if best and best[0] > own + 1e-3:
                    _, f, i, vl, vr = best
                    mid = (vl + vr) / 2
                    low_l, high_l, low_r, high_r = low, high, low, high
                    if directions[f] > 0:
                        high_l = low_r = mid
                    elif directions[f] < 0:
                        low_l = high_r = mid
                    right = binned[rows, f] > i
                    nodes[at][:2] = [f, float(cuts[f][i])]
                    nodes[at][2] = grow(rows[~right], level + 1, low_l, high_l)
                    nodes[at][3] = grow(rows[right], level + 1, low_r, high_r)
                    return at
            score[rows] += rate * value
            return at

        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    cols = list(zip(*nodes, strict=True))
    return Trees(np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), np.array(cols[3]), np.array(cols[4]), np.array(roots), base, depth)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Trees | None:
    """Fit on at most ``sample`` labelled documents; None where the labels are not of both kinds."""
    good = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = min(1.0, 0.95 * sample / max(1, good.count()))
    picked = good.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample)
    names = [*FEATURES]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features_of(text_statistics(column(b, "text")))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "quality"), *(pa.array(x[:, i]) for i in range(len(names)))], ["doc_id", "quality", *names])

    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    got = rows.mapInArrow(measure, f"doc_id long, quality int, {', '.join(f'{n} double' for n in names)}").limit(2 * sample).toPandas()
    got = got.sort_values(["doc_id", *names], ignore_index=True)
    x, y, ids = got[names].to_numpy(), got["quality"].to_numpy(np.float64), got["doc_id"].to_numpy(np.uint64)
    if len(np.unique(y)) < 2:
        return None
    directions = [*FEATURES.values()]
    held = mix(ids + np.uint64(7)) % np.uint64(5) == 0
    model = fit(x, y, directions)
    if len(np.unique(y[~held])) == 2 and (y[held] == 1).any():
        good_scores = fit(x[~held], y[~held], directions).probability(x[held & (y == 1)])
        model.threshold = min(0.5, float(np.quantile(good_scores, 0.001)))
    return model


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """``docs`` with its counts, ``base_failed``, ``quality_score`` and ``kept``."""
    model = train(docs, labels, sample)
    extra = T.StructType([T.StructField(k, T.LongType()) for k in COUNTS])
    extra.add("base_failed", "boolean").add("quality_score", "double").add("kept", "boolean")
    named = {f.name.lower() for f in extra}
    rest = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in named])
    schema = T.StructType([*rest.schema, *extra])
    n_rest = len(rest.columns)
    at = next(i for i, c in enumerate(rest.columns) if c.lower() == "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = text_statistics(b.column(at))
            failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
            p = model.probability(features_of(s)) if model else np.ones(b.num_rows)
            kept = ~failed & (p >= (model.threshold if model else 0))
            new = [*(pa.array(s[k]) for k in COUNTS), pa.array(failed), pa.array(p), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n_rest)), *new], schema.names)

    return rest.mapInArrow(judge, schema)
