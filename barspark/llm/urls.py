"""URL filter: a blocked Bloom filter in front of an exact hash join, with built-in functions only.

Rules are canonical address prefixes, ``host/path``, each with a verdict; a rule holds for its host and all subdomains where
the address's path starts with the rule's. The longest rule wins. Every page is asked for under each form that a listed
address can have: the list's shapes (labels in the host, length of the path) say which suffix of the host and which prefix of the
path to join into a key. The filter has 256-bit blocks, 16 bits a key; a key's hash names its block and eight bits there, so
one look-up by block number answers for it. What passes meets the list in a join on the key itself, which removes false hits.

List and filter are broadcast only while the list holds at most ``BROADCAST_KEYS`` keys of at most 2,083 characters each; beyond,
both joins shuffle, and hits, which may all be on one popular prefix, are salted.

Defined results: a null address, or one without ``://``, has empty host and path and no rule; no rule gives the ``default``
verdict; repeated rows are judged each; null ids are carried; an empty list gives the default everywhere; an empty table gives
an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

BROADCAST_KEYS, BROADCAST_LENGTH, SALTS, BLOCK_BITS, BITS_A_KEY, PROBES = 20_000, 2083, 16, 256, 16, 8


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(rules: DataFrame) -> DataFrame:
    """rule, verdict, key, labels, size. A rule written twice counts once: the verdict that sorts first."""
    host = lower_ascii(F.regexp_extract("rule", "^([^/]*)", 1))
    path = F.regexp_extract("rule", "^[^/]*(.*)$", 1)
    one = rules.filter("rule IS NOT NULL").select("rule", "verdict", host.alias("host"), path.alias("path"))
    one = one.groupBy("host", "path").agg(F.min("rule").alias("rule"), F.min("verdict").alias("verdict"))
    return one.select("rule", "verdict", F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("size"))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _bits(key: Column) -> Column:
    """Eight positions in a block, from eight bytes of a second hash."""
    h = F.xxhash64(key, F.lit(1))
    return F.array(*[F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(PROBES)])


def bloom_filter(keys: DataFrame, n_blocks: int) -> DataFrame:
    """block, words (four longs) of the blocks that have bits."""
    bits = keys.select(_block(F.col("key"), n_blocks).alias("block"), F.explode(_bits(F.col("key"))).alias("p"))
    words = [F.bit_or(F.when(F.floor(F.col("p") / 64) == w, F.expr("shiftleft(1L, p % 64)")).otherwise(F.lit(0).cast("long"))) for w in range(BLOCK_BITS // 64)]
    return bits.groupBy("block").agg(F.array(*words).alias("words"))


def may_hold(words: Column, key: Column) -> Column:
    return F.forall(_bits(key), lambda p: F.getbit(F.get(words, F.floor(p / 64).cast("int")), p % 64) == 1)


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url); ``rules``: rule, verdict."""
    keys = listed(rules)
    n, longest = keys.agg(F.count("*"), F.max(F.length("key"))).first()
    shapes = keys.select("labels", "size").distinct().collect()  # bounded by the lengths that a rule may have
    base = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = written(base, "addresses")  # read twice by row number: number the rows once
    best = F.struct(F.lit(None).cast("int").alias("size"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    if not n:
        return base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", r"\.")
    shape = F.array(*[F.struct(F.lit(r["labels"]).alias("labels"), F.lit(r["size"]).alias("size")) for r in shapes])
    fits = F.filter(shape, lambda s: (s["labels"] <= F.size("l")) & (s["size"] <= F.length("path")))
    key = F.transform(fits, lambda s: F.concat(F.array_join(F.slice("l", F.size("l") - s["labels"] + 1, s["labels"]), "."), F.substring(F.col("path"), F.lit(1), s["size"])))
    asked = base.withColumn("l", labels).select("row", F.explode(key).alias("key"))
    n_blocks = -(-n * BITS_A_KEY // BLOCK_BITS)
    blocks = bloom_filter(keys, n_blocks)
    small = n <= BROADCAST_KEYS and longest <= BROADCAST_LENGTH
    hint = F.broadcast if small else (lambda df: df)
    possible = asked.withColumn("block", _block(F.col("key"), n_blocks)).join(hint(blocks), "block").filter(may_hold(F.col("words"), F.col("key")))
    if small:
        hits = possible.select("row", "key").join(F.broadcast(keys), "key")
    else:
        salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = possible.select("row", "key", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["key", "salt"])
    hits = hits.select("row", *[F.lit(None).cast(t).alias(c) for c, t in (("page_id", pages.schema["page_id"].dataType), ("host", "string"), ("path", "string"))],
                       F.struct(F.length("rule").alias("size"), "rule", "verdict").alias("best"))
    rows = base.withColumn("best", best).unionByName(hits).groupBy("row")
    out = rows.agg(*[F.max(c).alias(c) for c in ("page_id", "host", "path")], F.max(F.when(F.col("best.rule").isNotNull(), F.col("best"))).alias("best"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
