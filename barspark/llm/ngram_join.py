"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its k-word shingles. Tokens (shingle hashes) have one global order: rare ones by hash, then
frequent ones by hash. A set of size s with a partner at the threshold lacks at most e = s - ceil(t s) of its tokens there,
so a prefix that needs more than e errors to lose every signature must share one. Rare tokens are signatures alone. For
frequent tokens the prefix is extended and pairs of them are signatures; sets of over 600 tokens form pairs only inside 64
hash classes of frequent tokens (a class of c tokens takes c - 1 errors to break), which keeps pairs near the number of
tokens. Sets of t * 600 to 600 tokens take part in both forms, so any two sets within the threshold's size ratio meet in one.

Signatures only propose. Proposals of small buckets are counted per pair and must reach the overlap that the rest of the
two sets cannot make up; then their bitmaps (a bit per token's hash, two to four bits a token) must not differ in more places than
linked sets may have tokens of their own. Buckets over ``SMALL`` members are tied by a key for each band of like size. The groups that result are verified whole, all
against all, in blocks of ``BLOCK`` sets per task; a task returns a spanning forest of the links that it found, never pairs
of a group. Equal sets are merged before all this and copies never meet. Sets are stored nowhere: texts of proposed groups
are shingled again.

Frequent: tokens in the first part of at least ``FREQUENT`` sets (and, for sets made mostly of such, anywhere). The list that
is broadcast holds at most 2**20 tokens; beyond that the bound doubles until it fits. It only moves tokens in the order: a
link is found whatever the list holds.

Defined results: null text and text without words have no shingles and link with nothing; texts of fewer than k words are
one shingle; repeated rows are copies; a null ``doc_id`` is carried, and a component's id ignores it; an empty table gives
an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, column, discard, mix, written
from .components import TIED, components, star_edges

FREQUENT, MOST_FREQUENT, SMALL, BLOCK, BROADCAST_KEYS = 32, 1 << 20, 64, 256, 1 << 20
ONE_CLASS_UP_TO, CLASSES = 600, 64
WAVE = 4
SIGNED = "node long, size long, key long, bits binary, rest long, sigs array<long>"
_U = np.uint64


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (as signed numbers) of each text."""
    h, at = w.windows(k)
    edges = np.searchsorted(w.doc[at], np.arange(w.n_docs + 1))
    signed = h.view(np.int64)
    sets = [np.unique(signed[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    for m in range(1, k):
        short = w.per_doc == m
        if short.any():
            hm, am = w.windows(m)
            own = short[w.doc[am]]
            for d, x in zip(w.doc[am[own]].tolist(), mix(hm[own] + _U(m)).view(np.int64).tolist(), strict=True):
                sets[d] = np.array([x], np.int64)
    return sets


def errors(size: np.ndarray | int, t: int) -> np.ndarray | int:
    """Tokens that a set may lack in a partner: size - ceil(t/100 * size)."""
    return size - (t * size + 99) // 100


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    n = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(n), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def _ravel(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def bitmap(tokens: np.ndarray) -> bytes:
    """Bits at the hashes of a set's tokens; a power of two of bits, twice the set's size at least."""
    m = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    bits = np.zeros(m, bool)
    bits[(tokens.view(_U) & _U(m - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(x: bytes, y: bytes, size_x: int, size_y: int, t: int) -> bool:
    """False where the bitmaps prove that the sets do not link: a bit of one alone is a token, or more, of that one alone."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    m, n = 8 * len(x), 8 * len(y)
    while m > n:
        m //= 2
        a = (a >> m) | (a & ((1 << m) - 1))
    while n > m:
        n //= 2
        b = (b >> n) | (b & ((1 << n) - 1))
    overlap = -(-t * (size_x + size_y) // (100 + t))
    return (a & ~b).bit_count() <= size_x - overlap and (b & ~a).bit_count() <= size_y - overlap


def fingerprints(docs: DataFrame, k: int, t: int) -> DataFrame:
    """rid, doc_id, key (hash of the text), size, fp1, fp2, bits (bitmap), head: the first tokens in hash order, some more than the errors allow."""
    least = -(-t // (100 - t))  # smaller sets can only equal a partner

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in blocks(column(b, "text"), lower=True):
                sets = shingle_sets(w, k)
                size = np.array([len(s) for s in sets], np.int64)
                fp1 = np.array([s.sum() if len(s) else 0 for s in sets], np.int64)
                fp2 = np.array([mix(s.view(_U) ^ _U(0xABCDEF)).sum().view(np.int64) if len(s) else 0 for s in sets], np.int64)
                need = errors(size, t) + 1
                take = np.where(size < least, 0, need + need // 8 + 8)
                head = _lists([s[:m] for s, m in zip(sets, take.tolist(), strict=True)])
                bits = pa.array([bitmap(s) if m else b"" for s, m in zip(sets, take.tolist(), strict=True)], pa.binary())
                cols = [*(column(b, c).slice(lo, hi - lo) for c in ("rid", "doc_id", "key")), pa.array(size), pa.array(fp1), pa.array(fp2), bits, head]
                yield pa.RecordBatch.from_arrays(cols, ["rid", "doc_id", "key", "size", "fp1", "fp2", "bits", "head"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(run, "rid long, doc_id long, key long, size long, fp1 long, fp2 long, bits binary, head array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int, cols: str) -> DataFrame:
    """``wanted`` (a stored table: key and the long columns ``cols``) with each one's shingle set, from one text of that key.

    Up to ``BROADCAST_KEYS`` keys (8 bytes each) are broadcast, so that only wanted texts are shuffled; beyond, all are."""
    keys = wanted.select("key").distinct()
    keys = F.broadcast(keys) if wanted.count() <= BROADCAST_KEYS else keys
    keyed = docs.filter("text IS NOT NULL").select(F.xxhash64("text").alias("key"), "text")
    texts = keyed.join(keys, "key", "left_semi").dropDuplicates(["key"]).join(wanted, "key")
    names = [c.strip() for c in cols.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in blocks(column(b, "text"), lower=True):
                yield pa.RecordBatch.from_arrays([*(column(b, c).slice(lo, hi - lo) for c in names), _lists(shingle_sets(w, k))], [*names, "tokens"])

    return texts.select(*names, "text").mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", tokens array<long>")


def frequent_tokens(tokens: DataFrame, least: int = FREQUENT) -> tuple[np.ndarray, int]:
    """Tokens of at least ``least`` rows, or twice that, and so on, until at most MOST_FREQUENT remain; and that bound."""
    counts = written(tokens.groupBy("token").count().filter(F.col("count") >= least), "frequent")
    steps = counts.groupBy(F.floor(F.log2(F.col("count") / least)).cast("int").alias("step")).count().collect()
    step = next(s for s in range(64) if sum(r["count"] for r in steps if r["step"] >= s) <= MOST_FREQUENT)
    got = counts.filter(F.col("count") >= least << step).select("token").toPandas()["token"].to_numpy(np.int64)
    discard(counts)
    return np.sort(got), least << step


def _contained(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def single_signatures(nodes: DataFrame, hot: np.ndarray, t: int) -> DataFrame:
    """node, size, key, bits, rest (tokens behind the prefix), sigs; sigs is empty where the head has too few rare tokens."""
    spread = nodes.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = _ravel(column(b, "head"))
            rare = ~_contained(flat, spread.value)
            size = column(b, "size").to_numpy()
            need = errors(size, t) + 1
            sigs = []
            for i, m in enumerate(need.tolist()):
                own = flat[at[i] : at[i + 1]][rare[at[i] : at[i + 1]]]
                sigs.append(own[:m] if len(own) >= m else np.zeros(0, np.int64))
            cols = [column(b, "node"), pa.array(size), column(b, "key"), column(b, "bits"), pa.array(size - need), _lists(sigs)]
            yield pa.RecordBatch.from_arrays(cols, ["node", "size", "key", "bits", "rest", "sigs"])

    return nodes.select("node", "size", "key", "bits", "head").mapInArrow(run, SIGNED)


def combination_signatures(tokens: np.ndarray, hot: np.ndarray, t: int) -> tuple[np.ndarray, int]:
    """Signatures of a set whose head has few rare tokens, and the tokens that may lie behind them: its rare ones, then pairs of frequent ones."""
    need = int(errors(len(tokens), t)) + 1
    rare, often = tokens[~hot], tokens[hot]
    if len(rare) >= need:
        return rare[:need], len(tokens) - need
    rest, out = need - len(rare), [rare]
    for classes in (1,) * (len(tokens) <= ONE_CLASS_UP_TO) + (CLASSES,) * (100 * len(tokens) >= t * ONE_CLASS_UP_TO):
        kind = (often.view(_U) >> _U(7)) % _U(classes)
        _, first = np.unique(kind, return_index=True)
        covers = np.ones(len(often), np.int64)
        covers[first] = 0
        used = int(np.searchsorted(np.cumsum(covers), rest)) + 1
        for c in np.unique(kind[:used]):
            own = often[:used][kind[:used] == c].view(_U)
            i, j = np.triu_indices(len(own), 1)
            out.append(mix(own[i] * _U(0x9E3779B97F4A7C15) + own[j] + _U(classes)).view(np.int64))
    return np.concatenate(out), len(tokens)


def paired_signatures(sets: DataFrame, hot: np.ndarray, t: int) -> DataFrame:
    spread = sets.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = _ravel(column(b, "tokens"))
            often = _contained(flat, spread.value)
            own = [flat[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            made = [combination_signatures(s, often[x : x + len(s)], t) for s, x in zip(own, at.tolist(), strict=False)]
            bits, rest = pa.array([bitmap(s) for s in own], pa.binary()), pa.array([m[1] for m in made], pa.int64())
            cols = [column(b, "node"), pa.array(np.diff(at)), column(b, "key"), bits, rest, _lists([m[0] for m in made])]
            yield pa.RecordBatch.from_arrays(cols, ["node", "size", "key", "bits", "rest", "sigs"])

    return sets.mapInArrow(run, SIGNED)


def _alike(pairs: DataFrame, signed: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) of nodes whose bitmaps leave room for a link."""
    side = lambda c: signed.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, n, m = (column(b, c).to_pylist() for c in ("bits_a", "bits_b", "size_a", "size_b"))
            keep = pa.array([may_link(*p, t) for p in zip(x, y, n, m, strict=True)], pa.bool_())
            yield b.select(["a", "b"]).filter(keep)

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def proposals(signed: DataFrame, t: int) -> DataFrame:
    """Edges (a, b) between sets whose signatures leave room for a link, or between sets and keys of large buckets, below zero."""
    # one shuffle of (signature, node) serves the counts and the join; sizes are added to those in small buckets
    n = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = signed.select("node", F.explode(F.array_distinct("sigs")).alias("sig")).repartition(n, "sig")
    many = rows.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1")
    met = rows.join(many, "sig")
    # small buckets: their pairs, each counted over all signatures
    small = met.filter(F.col("n") <= SMALL).join(signed.select("node", "size", "rest"), "node")
    small = small.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("size", "node", "rest"))).alias("m"))
    pairs = F.flatten(
        F.transform("m", lambda x, i: F.transform(
            F.filter("m", lambda y, j: (j > i) & (F.lit(t) * y["size"] <= F.lit(100) * x["size"])), lambda y: F.struct(x.alias("x"), y.alias("y"))
        ))
    )
    p = small.select(F.explode(pairs).alias("p")).select("p.x", "p.y").groupBy("x", "y").agg(F.count("*").alias("shared"))
    # overlap wanted: 100 o >= t (sx + sy - o); what the prefixes do not share must lie behind one of them
    wanted = F.ceil(F.lit(t) * (F.col("x.size") + F.col("y.size")) / F.lit(100.0 + t) - 1e-6)
    near = p.filter(F.col("shared") + F.greatest("x.rest", "y.rest") >= wanted).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    near = _alike(near, signed, t)
    # large buckets: a row for each set that is in some, with their signatures
    large = met.filter(F.col("n") > SMALL).groupBy("node").agg(F.collect_list("sig").alias("sigs"))
    return near.unionByName(_bucket_stars(large.join(signed.select("node", "size"), "node"), t))


def _bucket_stars(large: DataFrame, t: int) -> DataFrame:
    """Edges (a, b) that tie the sets of each bucket whose sizes lie in the same band or the next one: a pair within the size ratio does.

    ``large`` has node, size and sigs. A set is tied to a key, a number below zero, of each of its signatures and its band, and to
    that of the band above. A task ties what it holds and passes on the root of each set and key that it has met."""

    def keys(sigs: np.ndarray, bands: np.ndarray) -> list[int]:
        return (-1 - (mix(sigs.view(_U) ^ mix(bands.astype(_U))) >> _U(1)).astype(np.int64)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars() -> pa.RecordBatch:
            a, b = star_edges(*held)
            roots = list(set(b))  # with themselves too: another task may lead them on
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a + roots, b + roots)], ["a", "b"])

        held: tuple[list[int], list[int]] = ([], [])
        for batch in batches:
            flat, at = _ravel(column(batch, "sigs"))
            band = np.floor(np.log(column(batch, "size").to_numpy()) / (-np.log(t / 100) * 1.001)).astype(np.int64)
            band, node = (np.repeat(x, np.diff(at)) for x in (band, column(batch, "node").to_numpy()))
            for lo in range(0, len(flat), TIED // 2):
                some = slice(lo, lo + TIED // 2)
                for up in (0, 1):
                    held[0].extend(node[some].tolist())
                    held[1].extend(keys(flat[some], band[some] + up))
                if len(held[0]) >= TIED:
                    yield stars()
                    held = ([], [])
        if held[0]:
            yield stars()

    tied = large.select("node", "size", "sigs").mapInArrow(run, "a long, b long")
    # what several tasks have met ties their roots; a key that leads to one root alone is needed no more
    met = tied.groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("roots"))
    ends = F.when(F.col("a") >= 0, F.array_union("roots", F.array("a"))).otherwise(F.col("roots"))
    return met.select(F.explode(ends).alias("a"), F.col("least").alias("b")).filter("a <> b")


def _forest(sets: list[np.ndarray], nodes: np.ndarray, left: int, t: int) -> list[tuple[int, int]]:
    """Spanning edges of the links among ``sets``; with 0 < left only between the first ``left`` and the others."""
    size = np.array([len(s) for s in sets])
    n = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    count = np.diff(np.concatenate([begin, [len(flat)]]))
    shared = np.zeros(n * n, np.int32)
    # tokens by how many sets hold them: all such token's owners form a matrix, and its column pairs are counted together
    for c in np.unique(count[count > 1]).tolist():
        rows = begin[count == c]
        step = max(1, (1 << 20) // (c * c))
        for i in range(0, len(rows), step):
            m = owner[rows[i : i + step, None] + np.arange(c)]
            shared += np.bincount((m[:, :, None] * n + m[:, None, :]).ravel(), minlength=n * n).astype(np.int32)
    o = shared.reshape(n, n).astype(np.int64)
    linked = 100 * o >= t * (size[:, None] + size[None, :] - o)
    if left:
        linked[:left, :left] = linked[left:, left:] = False
    parent, edges = list(range(n)), []

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1))), strict=True):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((int(nodes[i]), int(nodes[j])))
    return edges


def _pairs_checked(dealt: DataFrame, t: int) -> DataFrame:
    """Links (a, b) inside each pair of blocks (g, i, j) of sets dealt to it, a spanning forest per pair."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("g", "i", "j", "own", "node", "tokens").repartition(n, "g", "i", "j").sortWithinPartitions("g", "i", "j", "own", "node")

    def links(rows: list) -> list[tuple[int, int]]:
        flats, nodes, left = [r[1] for r in rows], np.array([r[0] for r in rows]), sum(r[2] for r in rows)
        return _forest(flats, nodes, left if 0 < left < len(rows) else 0, t) if len(rows) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for b in batches:
            flat, at = _ravel(column(b, "tokens"))
            g, i, j, own, node = (column(b, c).to_pylist() for c in ("g", "i", "j", "own", "node"))
            for x in range(b.num_rows):
                if (g[x], i[x], j[x]) != key:
                    out += links(rows)
                    key, rows = (g[x], i[x], j[x]), []
                # between two blocks only links across them are new; the first block's sets come first
                rows.append((node[x], flat[at[x] : at[x + 1]], i[x] != j[x] and own[x] == i[x]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], ["a", "b"])
                out = []
        if out := links(rows):
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _block_of(n: Column | str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(n) if isinstance(n, str) else n).cast("int")


def _between(i: Column, j: Column) -> Column:
    return F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"))


def verified(groups: DataFrame, t: int) -> DataFrame:
    """``groups`` (node, g, tokens), a stored table, to stored links (a, b) with the components of all links.

    First every block of a group meets itself and the group's first block. Sets of one component then need no further pair among
    themselves, so only the sets outside a group's largest component meet all blocks: every set is copied twice, and once more for
    each block of such outsiders, not once for each block of the group."""
    sized = groups.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("g", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    sized = written(sized, "large-groups")
    own = groups.join(sized, "g", "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("own", _block_of("nb"))
    with_first = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: _between(F.lit(0), j))
    pairs = F.when(F.col("own") == 0, with_first).otherwise(F.array(_between(F.col("own"), F.col("own")), _between(F.lit(0), F.col("own"))))
    first = written(_pairs_checked(own.withColumn("p", F.explode(pairs)).select("*", "p.i", "p.j"), t), "first-links")
    if sized.isEmpty():
        return first
    found = components(first)
    big = groups.select("node", "g").join(sized.select("g"), "g").join(found, "node", "left").withColumn("c", F.coalesce("component", "node"))
    counts = big.groupBy("g", "c").agg(F.count("*").alias("n"))
    mains = counts.groupBy("g").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("held"))
    up = lambda c: F.ceil(c / BLOCK).cast("int")
    mains = mains.filter(F.col("all") > F.col("held")).select("g", "main", up(F.col("all") - F.col("held")).alias("ns"), up(F.col("held")).alias("nm"))
    places = written(big.select("node", "g", "c").join(mains, "g").select("node", "g", (F.col("c") != F.col("main")).alias("outside"), "ns", "nm"), "outsiders")
    own = groups.join(places, ["g", "node"]).withColumn("own", F.when(F.col("outside"), _block_of("ns")).otherwise(F.col("ns") + _block_of("nm")))
    every = F.when(F.col("outside"), F.col("ns") + F.col("nm")).otherwise(F.col("ns"))
    pairs = F.transform(F.sequence(F.lit(0), every - 1), lambda j: _between(F.col("own"), j))
    # a few blocks of outsiders at a time: a wave copies a set WAVE times at most, and its shuffle goes before the next one's
    waves = [first]
    for low in range(0, places.agg(F.coalesce(F.max("ns"), F.lit(0))).first()[0], WAVE):
        now = F.filter(pairs, lambda p: (p["i"] >= low) & (p["i"] < low + WAVE))  # noqa: B023
        waves.append(written(_pairs_checked(own.withColumn("p", F.explode(now)).select("*", "p.i", "p.j"), t), "more-links"))
    links = waves[0]
    for more in waves[1:]:
        links = links.unionByName(more)
    links = written(links, "links")
    discard(sized, found, places, *waves)
    return links


def jaccard_components(docs: DataFrame, k: int = 3, t: int = 90) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, component_id, rid, first (rid of the component's first row); links at 100 * |x & y| >= t * |x | y|, t < 100."""
    prints = written(fingerprints(docs, k, t), "fingerprints")
    least = F.min(F.struct("rid", "key")).alias("m")
    nodes = prints.filter("size > 0").groupBy("fp1", "fp2").agg(least, F.min("doc_id").alias("doc"))
    nodes = written(nodes.select("fp1", "fp2", F.col("m.rid").alias("node"), F.col("m.key").alias("key"), "doc"), "sets")
    ids, few = nodes.select(F.col("node").alias("rid")), nodes.count() <= BROADCAST_KEYS
    some = prints.filter(F.size("head") > 0).join(F.broadcast(ids) if few else ids, "rid", "left_semi")
    some = written(some.select(F.col("rid").alias("node"), "size", "key", "bits", "head"), "heads")
    rows = written(prints.drop("head", "bits"), "rows")
    discard(prints)
    need = (F.col("size") - F.floor((t * F.col("size") + 99) / 100) + 1).cast("int")
    hot, least_df = frequent_tokens(some.select(F.explode(F.slice("head", 1, need)).alias("token")))
    # sets made mostly of frequent tokens show more of them than heads do
    dense = F.size("sigs") == 0
    few_rare = written(single_signatures(some, hot, t).filter(dense).select("key", "node"), "dense")
    more, _ = frequent_tokens(sets_of(docs, few_rare, k, "node, key").select(F.explode("tokens").alias("token")), least_df)
    hot = np.union1d(hot, more)
    single = written(single_signatures(some, hot, t), "signatures")
    discard(some, few_rare)
    # stored between two Python steps: else each task keeps two workers
    sets = written(sets_of(docs, single.filter(dense).select("key", "node"), k, "node, key"), "dense-sets")
    paired = written(paired_signatures(sets, hot, t), "paired")
    discard(sets)
    proposed = written(proposals(single.filter(~dense).unionByName(paired), t), "proposed")
    discard(single, paired)
    coarse = components(proposed)
    discard(proposed)
    wanted = written(coarse.join(nodes.select("node", "key"), "node").select("node", F.col("component").alias("g"), "key"), "wanted")
    groups = written(sets_of(docs, wanted, k, "node, g"), "groups")
    discard(coarse, wanted)
    links = verified(groups, t)
    discard(groups)
    linked = components(links)
    discard(links)
    # the result: sets to components, components to their least document
    placed = nodes.select("fp1", "fp2", "node", "doc").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = placed.groupBy("component").agg(F.min("doc").alias("component_id"))
    by_set = placed.join(heads, "component").select("fp1", "fp2", "component_id", F.col("component").alias("first"))
    out = rows.join(by_set, ["fp1", "fp2"], "left")
    own = F.col("size") > 0
    return out.select(
        "doc_id", "key", F.col("size").alias("n_shingles"), F.when(own, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "rid",
        F.when(own, F.col("first")).otherwise(F.col("rid")).alias("first"),
    )


def one_of_each(docs: DataFrame, k: int = 5, t: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the row of least ``doc_id`` (a null one last; of several, the one whose text has the
    least hash; of rows equal in id and text, one). Texts without words all stay.

    The rows that stay are found again by their id and the hash of their text, both in the row itself, never by a row number."""
    found = jaccard_components(docs, k, t)
    row = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.col("key"))
    best = found.filter("n_shingles > 0").groupBy("first").agg(F.min(row).alias("b"), F.min("doc_id").isNull().alias("none")).select("b.id", "b.key", "none")
    alike = found.groupBy(row["id"].alias("id"), "key", F.col("doc_id").isNull().alias("none")).agg(F.count("*").alias("n"))
    best = written(best.join(alike, ["id", "key", "none"]), "kept")
    hint = F.broadcast if best.count() <= BROADCAST_KEYS else (lambda df: df)  # 25 bytes each
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("key"), F.col("doc_id").isNull().alias("none")]
    held = docs.select(F.struct(*docs.columns).alias("doc"), *own)
    single = held.join(hint(best.filter("n = 1")), ["id", "key", "none"], "left_semi")
    several = held.join(hint(best.filter("n > 1")), ["id", "key", "none"], "left_semi").dropDuplicates(["id", "key", "none"])
    kept = single.unionByName(several).select("doc.*")
    return kept.unionByName(docs.filter(F.coalesce("text", F.lit("")).rlike(r"^[\x20\x09-\x0D]*+$")))
