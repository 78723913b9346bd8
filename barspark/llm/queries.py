"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, chat, interplay, mixing, ngram_join, packing, pii, quality, subwords, topk, urls, whiten
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    scored = brown.score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


#: The wanted rules.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL["op3_url_filter"] = f"""
WITH rules(rule, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
listed AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM rules),
parts AS (SELECT row_number() OVER () AS n, page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {_AZ}) AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
met AS (SELECT parts.*, rule, verdict FROM parts LEFT JOIN listed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT any_value(page_id) AS page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule, length(rule)) AS rule,
  coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict FROM met GROUP BY n"""


@query
def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


@query
def op5_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


@query
def op6_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(table(spark, sf_dir, "conversations"))


@query
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.quality_rules(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "quality_score")


@query
def op9_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.token_counts(table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"))


@query
def op10_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = subwords.n_best(table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"), n=3, check=True)
    return best.select("doc_id", "rank", "cost", "n_pieces", F.crc32("ids").alias("ids_crc32"), "round_trip")


@query
def op11_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whiten.whiten(table(spark, sf_dir, "embeddings"), components=16)
    explained = F.array(*(F.lit(e).cast("double") for e in made.explained)) if made.explained else F.array(F.lit(None).cast("double"))
    rows = made.rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(made.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(made.identity_error).alias("identity_error"),
    )


@query
def op12_multinomial_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


_N = mixing.BLOCK
SQL["op12_multinomial_mix"] = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size, row_number() OVER () AS r FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, greatest(1, count(*) // {mixing.BUCKET}) AS buckets, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
g1 AS (SELECT *, CAST([5, 2, 1][CAST(no % 3 + 1 AS INT)] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS stop, (source_size + {_N - 1}) // {_N} AS blocks FROM g),
g2 AS (SELECT *, stop / w AS level, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(stop) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS here
  FROM g1 WINDOW b AS (ORDER BY stop / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g3 AS (SELECT *, least(stop, w * (SELECT here FROM g2 WHERE level >= here ORDER BY level, no LIMIT 1)) AS target FROM g2),
g4 AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(least(2 * blocks, floor(target * blocks / source_size + 0.5)) AS BIGINT) END AS slots FROM g3),
g5 AS (SELECT *, CAST(sum(slots) OVER () AS BIGINT) AS total, CAST(sum(slots) OVER (ORDER BY no) AS BIGINT) AS upto FROM g4),
g6 AS (SELECT *, CASE WHEN total > 0 THEN CAST(floor((upto - slots)::DOUBLE / total * 2147483647.0::DOUBLE) AS BIGINT) END AS low,
  CASE WHEN total > 0 THEN CAST(floor(upto::DOUBLE / total * 2147483647.0::DOUBLE) AS BIGINT) END AS high FROM g5),
placed AS (SELECT d.*, g6.no, g6.source_size, g6.target, CAST(coalesce(sum(size) OVER (PARTITION BY g6.no ORDER BY ({mixing.bucket_hash("doc_id", "size")}) % buckets,
  doc_id NULLS FIRST, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM d JOIN g6 ON d.source IS NOT DISTINCT FROM g6.source),
draws AS (SELECT range AS slot, {mixing.drawn("range")} AS u FROM range((SELECT coalesce(max(total), 0) FROM g6))),
met AS (SELECT slot, no, blocks, slots, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS i FROM draws JOIN g6 ON u >= low AND u < high),
s1 AS (SELECT no, blocks, slots, coalesce(n, 0) AS n FROM g6 LEFT JOIN (SELECT no AS k, count(*) AS n FROM met GROUP BY no) ON no = k),
s2 AS (SELECT *, sum(greatest(n - slots, 0)) OVER (ORDER BY no) - greatest(n - slots, 0) AS over_low, sum(greatest(slots - n, 0)) OVER (ORDER BY no) AS short_high, greatest(slots - n, 0) AS short FROM s1),
vacant AS (SELECT i - met.slots + over_low AS v FROM met JOIN s2 USING (no) WHERE i >= met.slots),
final AS (SELECT no, blocks, i FROM met WHERE i < slots UNION ALL SELECT no, blocks, CAST(n + v - (short_high - short) AS BIGINT) FROM vacant JOIN s2 ON v >= short_high - short AND v < short_high),
f1 AS (SELECT no, blocks, i % blocks AS j, {mixing.round_key("no", "(i // blocks)")} AS key FROM final),
f2 AS (SELECT *, list_transform(range({mixing.ROUNDS}), lambda r: {mixing.reflection("key", "r", "blocks")}) AS ks FROM f1),
f3 AS (SELECT no, list_reduce(list_prepend(j, ks), lambda x, k: {mixing.swapped("x", "k", "blocks", "key")}) AS block FROM f2),
pieces AS (SELECT r, no, unnest(range(first // {_N}, (first + size - 1) // {_N} + 1)) AS block, first, size FROM placed WHERE size > 0),
sums AS (SELECT r, sum(least((block + 1) * {_N}, first + size) - greatest(block * {_N}, first)) AS taken FROM pieces JOIN f3 USING (no, block) GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN sums USING (r)"""


@query
def op13_filter_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interplay.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op13_filter_diagrams"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS lo FROM d),
l AS (SELECT doc_id, max(CAST(coalesce(quality, 0) = 1 AS INT)) AS g, max(CAST(coalesce(toxic, 0) = 1 AS INT)) AS x FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(g, 0) AS g, coalesce(x, 0) AS x, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
  + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
  + 16 * CAST(coalesce(w.doc_id > lo, false) AS INT) AS mask FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(g) AS g, sum(x) AS x FROM m GROUP BY ALL),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p(o, step, letter, bit, before) AS (SELECT '', 0, '', 0, 0 UNION ALL SELECT o || f.letter, step + 1, f.letter, f.bit, before + p.bit FROM p JOIN f ON NOT contains(o, f.letter)),
full_orders AS (SELECT o FROM p WHERE step = 5),
s AS (SELECT full_orders.o, p.step, p.letter, p.bit, p.before FROM full_orders JOIN p ON p.step > 0 AND starts_with(full_orders.o, p.o)),
r AS (SELECT part, o AS filter_order, step, s.letter, sum(n) FILTER (mask & (before + bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
  sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
  sum(g) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost, sum(x) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost FROM s CROSS JOIN c GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley FROM r"""

SQL["op5_norm_buckets"] = """
WITH v AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (SELECT q.n AS q, q.vec_id AS query_id, c.n, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, n) AS rank FROM pairs) WHERE rank <= 10"""

SQL["op7_ngram_jaccard"] = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s FROM w),
tokens AS (SELECT r, unnest(s) AS t FROM sets),
met AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM tokens a JOIN tokens b ON a.t = b.t AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sets x ON x.r = a JOIN sets y ON y.r = b WHERE 100 * o >= 90 * (len(x.s) + len(y.s) - o)),
reach(root, r) AS (SELECT r, r FROM sets UNION SELECT root, b FROM reach JOIN links ON a = r),
least AS (SELECT root, min(doc_id) AS component_id FROM reach JOIN sets USING (r) GROUP BY root)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN least ON root = r"""
