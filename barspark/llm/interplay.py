"""How five document filters interact in every order, audited on decision diagrams of failure masks.

Spark reads each text once for its failure mask, aggregates the masks by text and part, and sums them to at most 32 counts per part.
Each part's counts become an ordered decision diagram: a level per filter, a pass and a fail edge per node, equal nodes shared, the
weight (documents, good ones, toxic ones) beneath a node kept in it, empty branches left out. An exchange of two adjacent levels
rewires only the nodes of those levels; 119 exchanges (each order differs from the one before by one) visit all 120 orders. The
all-pass path from the root gives an order's steps: what leaves by the fail edge is removed there, what stays is kept.

Filters: A under 200 words; B distinct words below half of the words; C capitals A-Z above 2 per cent of the code points; D one of
``#$%&*|`` present; E equal to the text of a document of smaller id anywhere in the table.

Defined results:

* null text is empty: no words, so A fails, B, C and D pass; null ``source`` is the part '' together with empty sources;
* a document without an id is never a copy and makes none; rows of the same id and text are no copies of each other;
* a document's labels are joined by id; of several label rows, one with 1 is enough; no row, or null: neither good nor toxic;
* every part that has documents has 600 rows; no documents, no rows; extra columns are ignored;
* a text of any length is judged whole, and texts are equal when their SHA-256 is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"

Weight = tuple[int, int, int]
NOTHING: Weight = (0, 0, 0)


class Node:
    """A decision of one filter over documents that met the same decisions before."""

    __slots__ = ("passed", "failed", "weight")

    def __init__(self, passed: Branch, failed: Branch):
        self.passed, self.failed = passed, failed
        self.weight: Weight = tuple(map(sum, zip(weight(passed), weight(failed), strict=True)))


#: A deeper node, the counts of one mask, or nothing.
Branch = Node | Weight | None


def weight(branch: Branch) -> Weight:
    return branch.weight if isinstance(branch, Node) else branch or NOTHING


class Diagram:
    """``levels[i]`` holds the nodes that decide ``order[i]``, by their two branches."""

    def __init__(self, counts: dict[int, Weight]):
        self.order = list(range(len(FILTERS)))
        self.levels: list[dict[tuple[Branch, Branch], Node]] = [{} for _ in FILTERS]
        self.root = self._grown(0, counts)

    def _grown(self, level: int, counts: dict[int, Weight]) -> Branch:
        """Bit ``i`` of a mask is set if filter ``i`` fails; all masks here agree in the bits of the levels above."""
        if not counts:
            return None
        if level == len(FILTERS):
            return next(iter(counts.values()))
        sides = [{m: c for m, c in counts.items() if m >> level & 1 == side} for side in (0, 1)]
        return self._shared(self.levels[level], *(self._grown(level + 1, s) for s in sides))

    @staticmethod
    def _shared(level: dict, passed: Branch, failed: Branch) -> Branch:
        if passed is None and failed is None:
            return None
        if (passed, failed) not in level:
            level[passed, failed] = Node(passed, failed)
        return level[passed, failed]

    def exchange(self, i: int) -> None:
        """Swap levels i and i + 1. Nodes of level i stay the same objects, so nothing above changes."""
        upper, lower = {}, {}
        for node in self.levels[i].values():
            (pp, pf), (fp, ff) = ((b.passed, b.failed) if b is not None else (None, None) for b in (node.passed, node.failed))
            node.passed, node.failed = self._shared(lower, pp, fp), self._shared(lower, pf, ff)
            upper[node.passed, node.failed] = node
        self.levels[i], self.levels[i + 1] = upper, lower
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]

    def path(self) -> Iterator[tuple[Weight, Weight]]:
        """(kept, removed) after each level, along the pass edges."""
        at = self.root
        for _ in self.order:
            yield (weight(at.passed), weight(at.failed)) if at else (NOTHING, NOTHING)
            at = at.passed if at else None


def exchanges(n: int) -> Iterator[int]:
    """Positions i of adjacent exchanges (i, i + 1) that lead from the identity through all orders of n, each once."""
    if n < 2:
        return
    inner, down = exchanges(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + down  # the largest stands in front after it moved down
        down = not down


_MOVES = list(exchanges(len(FILTERS)))


def audited(counts: dict[int, Weight]) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part, by order."""
    diagram, seen = Diagram(counts), []
    for move in [None, *_MOVES]:
        if move is not None:
            diagram.exchange(move)
        seen += [(tuple(diagram.order), step, kept, gone) for step, (kept, gone) in enumerate(diagram.path())]
    failing, alone, total = {}, {}, dict.fromkeys(range(len(FILTERS)), 0)
    for order, step, _, gone in seen:
        f = order[step]
        total[f] += gone[0]
        if step == 0:
            failing[f] = gone[0]
        if step == len(FILTERS) - 1:
            alone[f] = gone[0]
    rows = []
    for order, step, kept, gone in seen:
        f = order[step]
        rows.append(("".join(FILTERS[o] for o in order), step + 1, kept[0], gone[0], failing[f] - gone[0], alone[f], gone[1], gone[2], total[f]))
    return rows


COLUMNS = ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS[2:])


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, masks in zip(column(batch, "part").to_pylist(), column(batch, "masks").to_pylist(), strict=True):
            rows = audited({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in masks if m["n"]})
            made = [pa.array(c, pa.string() if i == 0 else pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))]
            yield pa.record_batch([pa.array([part] * len(rows)), *made], ["part", *COLUMNS])


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the filters they fail, bit i for filter i."""
    text = F.coalesce("text", F.lit(""))
    words = F.split(F.btrim(text, F.lit(BLANKS)), SPACE)
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    n = F.when(F.col("words")[0] == "", 0).otherwise(F.size("words"))
    few = (n < 200).cast("int")
    repeats = ((n > 0) & (100 * F.size(F.array_distinct("words")) < 50 * n)).cast("int")
    capitals = (100 * F.regexp_count("text", F.lit("[A-Z]")) > 2 * F.length("text")).cast("int")
    marks = F.col("text").rlike(r"[#$%&*|]").cast("int")
    own = read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), (few + 2 * repeats + 4 * capitals + 8 * marks).alias("mask"))
    # a salt spreads rows without an id over all tasks of the join
    own = own.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("key"), F.lit(4096))).otherwise(F.lit(0)).cast("int"))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"), F.lit(0).alias("none"))
    known = known.agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("g"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("t"))
    met = own.join(known, (F.col("doc_id") == F.col("id")) & (F.col("salt") == F.col("none")), "left")
    rows = met.groupBy("doc_id", "salt", "part", "key", "mask").agg(
        F.count("*").alias("n"), F.max(F.coalesce("g", F.lit(0))).alias("g"), F.max(F.coalesce("t", F.lit(0))).alias("t")
    )
    n, g, t, named = F.col("n"), F.col("n") * F.col("g"), F.col("n") * F.col("t"), F.col("doc_id").isNotNull()
    texts = rows.groupBy("part", "key", "mask").agg(
        F.array(*(F.sum(F.when(~named, c).otherwise(0)) for c in (n, g, t))).alias("unnamed"),
        F.array(*(F.sum(F.when(named, c).otherwise(0)) for c in (n, g, t))).alias("named"),
        F.min(F.when(named, F.struct("doc_id", n.alias("n"), g.alias("good"), t.alias("toxic")))).alias("least"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("key"))
    texts = texts.withColumn("original", F.coalesce(F.col("least.doc_id") == first, F.lit(False)))
    once = [F.when(F.col("original"), F.col(f"least.{c}")).otherwise(0) for c in ("n", "good", "toxic")]
    sides = [F.struct((F.col("mask") + 16 * e).alias("mask"), *(v(i).alias(c) for i, c in enumerate(("n", "good", "toxic")))) for e, v in (
        (0, lambda i: F.col("unnamed")[i] + once[i]), (1, lambda i: F.col("named")[i] - once[i]))]
    split = texts.select("part", F.explode(F.array(*sides)).alias("s")).select("part", "s.*")
    return split.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, zeros included."""
    masks = failure_masks(docs, labels)
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most
    return parts.mapInArrow(_audit, SCHEMA)
