"""Mixing sources to target weights: blocks of words, multinomial draws per output shard, permuted indices, a join by index.

1. The words of each source, document after document, are packed into blocks of ``BLOCK`` words (the last one may be shorter).
   A document's place comes from sums per hash bucket and sums of buckets, so a source of any size is spread over tasks.
2. Sources share ``share`` of all words by weight; a target stops at ``most`` times its source and the excess goes to the others.
3. The output is slots of one block, ``SHARD`` of them to a shard. Every slot draws its source with the targets as probabilities,
   which makes a shard's counts multinomial. Where the draws of all shards leave a source over its planned slots, the last of them
   are handed to sources below theirs, so that every source meets its target up to a block.
4. The i-th slot of a source with B blocks takes block p(i mod B) of round i div B, p being a pseudorandom permutation of 0..B-1
   (swap or not: 12 rounds of reflections, each taken or left by a hash bit), and is joined with that block by index.

A slot index never passes ``most`` * B, so no block, and no document, is taken more than ``most`` times. All draws are arithmetic on
indices: reruns and retries agree. Nothing but DataFrame and SQL functions is used.

Defined results:

* null text has no words; a document without words is placed nowhere and never taken; null sources form one source, the last;
* ids may be null or repeated: a document is a row. Rows equal in source, id and size are placed next to each other;
* sources are ranked by code point in one task: a row per source, whatever the number of documents. Up to ``FEW`` of them (counted
  first) are broadcast to the documents, more are joined with salted keys;
* an empty table, or one without words, gives no slots; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK = 64
SHARD = 1024
ROUNDS = 12
#: Documents of a source to a bucket, on average.
BUCKET = 4096
#: Sources that are broadcast.
FEW = 100_000
SALTS = 64
#: Slots that a task handles: their rows are small and their arithmetic is not, so sizes in bytes would leave too few tasks.
SLOTS_A_TASK = 1 << 17

_P, _Q, _BIG = 2147483647, 2147483629, 1152921504606846883


def q(x: str) -> str:
    """SQL of a pseudorandom number below 2**31 - 1 of x, 0 <= x < 2**62: a square modulo one prime plus a multiple modulo another."""
    return f"((({x}) % {_P}) * (({x}) % {_P}) + (({x}) % {_Q}) * 40014 + 12345) % {_P}"


def drawn(slot: str) -> str:
    """SQL of a slot's draw, uniform over 0 .. 2**31 - 2."""
    return q(f"({q(f'{slot} + {_BIG}')}) * 69621 + {slot}")


def round_key(source: str, turn: str) -> str:
    return q(f"({source} * 2 + {turn}) * 1000003 + {_BIG}")


def reflection(key: str, r: str, n: str) -> str:
    return f"(({q(f'{key} * 1048583 + {r} * 1000003')}) * {_Q}) % {n}"


def swapped(j: str, k: str, n: str, key: str) -> str:
    """SQL of one round: j, or its mirror image k - j modulo n; both mirror images see the same hash bit."""
    mirror = f"(({k} - {j} + {n}) % {n})"
    bit = q(f"greatest({j}, {mirror}) + {k} * 4099 + {key} * 65537")
    return f"CASE WHEN ({bit}) % 2 = 0 THEN {j} ELSE {mirror} END"


def bucket_hash(doc_id: str, size: str) -> str:
    return q(f"((coalesce({doc_id}, -1) % {_P} + {_P}) % {_P}) * 65537 + {size} % 65521")


class Mix(NamedTuple):
    """``sources``: source, no, source_size, target, blocks, slots (a row each). ``placed``: doc_id, size, no, source_size, target,
    first (the document's first word in its source, null without words), and ``text`` if wanted. ``pieces``: a row per document in
    each slot: slot, shard, no, turn, block, doc_id, first, start (its first word in the document), length, and ``words`` if wanted."""

    sources: DataFrame
    placed: DataFrame
    pieces: DataFrame


def _targets(sized: DataFrame, share: float, most: float, block: int) -> DataFrame:
    """Targets filled up from the sources that reach their stop first, blocks and planned slots."""
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = sums.withColumn("no", F.row_number().over(by_rank).cast("long") - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("no") % len(WEIGHTS) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("weight", weight).withColumn("stop", F.lit(float(most)) * F.col("source_size"))
    ranked = ranked.withColumn("level", F.col("stop") / F.col("weight"))
    everywhere = Window.partitionBy()
    before = Window.orderBy("level", "no").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.lit(float(share)) * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level_here", rest / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    reached = F.min(F.when(F.col("level") >= F.col("level_here"), F.struct("level", "no", "level_here"))).over(everywhere)["level_here"]
    ranked = ranked.withColumn("target", F.least("stop", reached * F.col("weight")))
    blocks = F.expr(f"(source_size + {block - 1}) div {block}")
    ranked = ranked.withColumn("blocks", blocks)
    plan = F.least(F.lit(most) * F.col("blocks"), F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5))
    ranked = ranked.withColumn("slots", F.when(F.col("source_size") == 0, 0).otherwise(plan).cast("long"))
    by_no = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto, total = F.sum("slots").over(by_no), F.sum("slots").over(everywhere)
    bound = lambda c: F.floor(c.cast("double") / total * F.lit(float(_P))).cast("long")
    ranked = ranked.withColumn("low", F.when(total > 0, bound(upto - F.col("slots")))).withColumn("high", F.when(total > 0, bound(upto)))
    buckets = F.greatest(F.lit(1), F.expr(f"docs div {BUCKET}"))
    return ranked.select("source", "no", "source_size", "target", "blocks", "slots", "low", "high", buckets.cast("long").alias("buckets"))


def _with_source(sized: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    own = sources.select(F.col("source").alias("s"), "no", "source_size", "target", "buckets")
    if n_sources <= FEW:
        return sized.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    salt = F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS))
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return sized.withColumn("sown", salt).join(own, F.col("source").eqNullSafe(F.col("s")) & (F.col("sown") == F.col("salt"))).drop("s", "source", "sown", "salt")


def _placed(met: DataFrame) -> DataFrame:
    """First word of each document with words in its source: buckets one after the other, by id and size inside them."""
    inside = met.filter("size > 0").withColumn("bucket", F.expr(f"({bucket_hash('doc_id', 'size')}) % buckets"))
    totals = inside.groupBy("no", "bucket").agg(F.sum("size").alias("filled"))
    before = Window.partitionBy("no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("no", "bucket", F.coalesce(F.sum("filled").over(before), F.lit(0)).alias("base"))
    here = Window.partitionBy("no", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("ahead", F.coalesce(F.sum("size").over(here), F.lit(0)))
    return inside.join(totals, ["no", "bucket"]).withColumn("first", F.col("base") + F.col("ahead")).drop("bucket", "ahead", "base", "buckets")


def _pieces(placed: DataFrame, block: int, text: bool) -> DataFrame:
    """(no, block, doc_id, first, start, length): the part of each document in each block."""
    words = [F.split(F.btrim("text", F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+").alias("all_words")] if text else []
    last = F.expr(f"sequence(first div {block}, (first + size - 1) div {block})")
    cut = placed.select("no", "doc_id", "first", "size", *words).select("*", F.explode(last).alias("block"))
    start = F.greatest(F.col("block") * block - F.col("first"), F.lit(0))
    cut = cut.withColumn("start", start).withColumn("length", F.least((F.col("block") + 1) * block - F.col("first"), F.col("size")) - F.col("start"))
    own = [F.slice("all_words", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("words")] if text else []
    return cut.select("no", "block", "doc_id", "first", "start", "length", *own)


def _ranged(value: Column, ranges: DataFrame, low: str, high: str, bits: int) -> tuple[Column, DataFrame]:
    """Join key of ``value``, and ranges cut at multiples of 2**bits: an equi-join on the key and a test of the bounds find the range."""
    keys = F.sequence(F.shiftright(low, bits), F.shiftright(F.col(high) - 1, bits))
    return F.shiftright(value, bits), ranges.filter(f"{high} > {low}").withColumn("range_key", F.explode(keys))


def _slots(spark: SparkSession, sources: DataFrame, n_slots: int) -> DataFrame:
    """(slot, shard, no, blocks, i): each slot's source and its number among the slots of that source."""
    slots = spark.range(0, n_slots, 1, max(1, -(-n_slots // SLOTS_A_TASK))).withColumnRenamed("id", "slot")
    slots = slots.withColumn("shard", F.expr(f"slot div {SHARD}")).withColumn("u", F.expr(drawn("slot")))
    key, ranges = _ranged(F.col("u"), sources.select("no", "blocks", "slots", "low", "high"), "low", "high", 19)
    slots = slots.join(ranges, (key == F.col("range_key")) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    slots = slots.select("slot", "shard", "no", "blocks", F.col("slots").alias("plan"))

    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    counts = slots.groupBy("shard", "no").agg(F.count("*").alias("n")).withColumn("group", F.expr(f"shard div {SHARD}"))
    groups = counts.groupBy("group", "no").agg(F.sum("n").alias("n"))
    groups = groups.withColumn("ahead", F.coalesce(F.sum("n").over(upto("no").orderBy("group")), F.lit(0)))
    all_drawn = groups.groupBy("no").agg(F.sum("n").alias("drawn")).withColumnRenamed("no", "drawn_no")
    settled = sources.select("no", "blocks", "slots").join(all_drawn, F.col("no") == F.col("drawn_no"), "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    over, short = F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))
    settled = settled.withColumn("over", over).withColumn("short", short)
    settled = settled.withColumn("over_low", F.coalesce(F.sum("over").over(upto().orderBy("no")), F.lit(0)))
    settled = settled.withColumn("short_low", F.coalesce(F.sum("short").over(upto().orderBy("no")), F.lit(0)))
    settled = settled.withColumn("short_high", F.col("short_low") + F.col("short"))

    bases = groups.select("group", "no", "ahead").join(settled.select("no", "over_low"), "no")
    counts = counts.withColumn("inside", F.coalesce(F.sum("n").over(upto("group", "no").orderBy("shard")), F.lit(0)))
    counts = counts.join(bases, ["group", "no"]).select("shard", "no", (F.col("ahead") + F.col("inside")).alias("base"), "over_low")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_slots // SLOTS_A_TASK))
    slots = slots.repartition(tasks, "shard", "no")  # a number of its own, which adaptive execution leaves alone
    rank = F.row_number().over(Window.partitionBy("shard", "no").orderBy("slot"))
    slots = slots.withColumn("rank", rank).join(counts, ["shard", "no"]).withColumn("i", F.col("base") + F.col("rank") - 1)
    # slots over the plan are numbered together and given to the ranges of sources short of theirs
    slots = slots.withColumn("v", F.when(F.col("i") >= F.col("plan"), F.col("over_low") + F.col("i") - F.col("plan")))
    key, ranges = _ranged(F.col("v"), settled.select(*(F.col(c).alias(f"to_{c}") for c in ("no", "blocks", "drawn", "short_low", "short_high"))), "to_short_low", "to_short_high", 10)
    kept = -1 - F.col("slot") % 4096  # meets nothing, and spreads the slots that stay
    met = (F.coalesce(key, kept) == F.col("range_key")) & (F.col("v") >= F.col("to_short_low")) & (F.col("v") < F.col("to_short_high"))
    slots = slots.join(ranges, met, "left")
    moved = F.col("to_no").isNotNull()
    return slots.select(
        "slot", "shard", F.when(moved, F.col("to_no")).otherwise(F.col("no")).alias("no"), F.when(moved, F.col("to_blocks")).otherwise(F.col("blocks")).alias("blocks"),
        F.when(moved, F.col("to_drawn") + F.col("v") - F.col("to_short_low")).otherwise(F.col("i")).alias("i"),
    )


def _permuted(slots: DataFrame) -> DataFrame:
    """(slot, shard, no, turn, block)."""
    turned = slots.withColumn("turn", F.expr("i div blocks")).withColumn("block", F.expr("i % blocks")).withColumn("key", F.expr(round_key("no", "turn")))
    for r in range(ROUNDS):  # a projection each: compiled one by one, where a lambda over an array would be interpreted
        turned = turned.withColumn("mirror", F.expr(reflection("key", f"{r}L", "blocks"))).withColumn("block", F.expr(swapped("block", "mirror", "blocks", "key")))
    return turned.select("slot", "shard", "no", "turn", "block")


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, block: int = BLOCK, text: bool = False) -> Mix:
    """Mix ``docs`` (doc_id, text, source) to ``share`` of its words; ``text`` adds the words themselves to the pieces."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = [F.coalesce("text", F.lit("")).alias("text")] if text else []
    sized = written(docs.select("doc_id", "source", size.alias("size"), *own), "sized")
    sources = written(_targets(sized, share, most, block), "sources")
    n_sources, n_slots = sources.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0))).first()
    met = _with_source(sized, sources, n_sources)
    placed = written(_placed(met), "placed")
    empty = met.filter("size = 0").select(*(F.lit(None).cast(kind).alias(c) if c == "first" else F.col(c) for c, kind in placed.dtypes))
    # stored: a predicate on ``block`` pushed through the rounds would be rewritten in terms of the first one's input
    slots = written(_permuted(_slots(docs.sparkSession, sources, n_slots)), "slots")
    pieces = _pieces(placed, block, text).join(slots, ["no", "block"])
    return Mix(sources, placed.unionByName(empty), pieces)


def taken(made: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes of each document, repeats counted."""
    sums = made.pieces.groupBy("no", "first").agg(F.sum("length").alias("taken"))
    columns = ("doc_id", "size", "source_size", "target")
    some = made.placed.filter("size > 0").join(sums, ["no", "first"], "left").select(*columns, F.coalesce("taken", F.lit(0)).alias("taken"))
    return some.unionByName(made.placed.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))
