import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.llm import brown, chat, components, lattice, ngram_join, packing, pii, quality, subwords, topk, urls
from barspark.llm.queries import URL_RULES, public_tokenizer
from tests.conftest import SF

from . import brute

WORDS, PIECES = public_tokenizer("word_bpe_49k.json"), public_tokenizer("piece_bpe_32k.model")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# packing


def unpacked(pieces):
    """{(doc_id, ids): count} put together again from pieces, after the layout has been checked."""
    seqs, docs = {}, {}
    for p in pieces:
        seqs.setdefault(p["sequence_id"], []).append(p)
        docs.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    for own in seqs.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and len(p["ids"]) == 4 * p["length"] > 0
            at += p["length"]
        assert at <= 2048
    full = [sum(p["length"] for p in own) for own in seqs.values()]
    assert sum(x != 2048 for x in full) <= 1
    return docs


def test_packing_holds_each_id_once(odd):
    from tokenizers import Tokenizer

    docs = unpacked(packing.pack(odd, WORDS).collect())
    t = Tokenizer.from_file(WORDS)
    for doc, text in texts_of(odd):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], np.uint32)
        own = sorted(docs[doc, len(ids)], key=lambda p: p["start"])
        starts = {}
        for p in own:
            assert p["ids"] == ids[p["start"] : p["start"] + p["length"]].tobytes()
            starts[p["start"]] = starts.get(p["start"], 0) + p["length"]
        assert sum(p["length"] for p in own) == len(ids) * (2 if doc == 9 else 1)


def test_packing_of_nothing_and_sequences(odd, nothing):
    assert packing.pack(nothing, WORDS).count() == 0
    pieces = packing.pack(odd, WORDS, length=64)
    n = pieces.agg(F.sum("length")).first()[0]
    got = packing.sequences(pieces).collect()
    assert sum(len(r["ids"]) for r in got) == 4 * n and all(sum(r["lengths"]) * 4 == len(r["ids"]) <= 256 for r in got)


def test_words_encode_like_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    some = ["<|endoftext|> a<|startoftext|>b", "A\u0308\u0301 e\u0301", "ΣΑΣ. İ ß ẞ", "it's I'll 'S don't--'t x'", "１２ ３a ½", "a\tb\rc\x0bd e\x1cf", "日本語 한국어", " NAÏVE CAFÉ—ok “q”..."]
    assert packing.token_bytes(WORDS, some) == [np.array([*t.encode(s, add_special_tokens=False).ids, 1], np.uint32).tobytes() for s in some]


def test_hilbert_curve_visits_each_cell_and_moves_one_step():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    path = grid[np.argsort(packing.hilbert(grid, 3))]
    assert sorted(packing.hilbert(grid, 3)) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# language model


def test_brown_base_and_held_out(spark, store, odd):
    teach = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1
    rows = texts_of(odd)
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, _ in rows]
    want = sorted(((-1 if i is None else i), *x[:3], round(x[3], 6)) for (i, _), x in zip(rows, brute.base_scores([t for _, t in rows], train), strict=True))
    got = brown.score(odd, teach).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_brown_beats_unigrams_on_held_out_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    r = brown.score(docs, ~held).filter(held).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


@pytest.mark.parametrize("table", [2, 1 << 17])
def test_brown_rare_words_by_join_equal_table(spark, odd, monkeypatch, table):
    teach = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))
    whole = {r["row"]: (r["n_known"], r["base_score"]) for r in brown.score(odd, teach).collect()}
    monkeypatch.setattr(brown, "TABLE", table)
    cut = {r["row"]: (r["n_known"], r["base_score"]) for r in brown.score(odd, teach).collect()}
    assert {k: v[0] for k, v in whole.items()} == {k: v[0] for k, v in cut.items()} and all(abs(whole[k][1] - cut[k][1]) < 1e-6 for k in whole)


def test_brown_without_training_or_rows(odd, nothing):
    assert all(r["n_known"] == 0 for r in brown.score(odd, F.lit(False)).collect())
    assert brown.score(nothing, F.lit(True)).count() == 0


def test_exchange_gain_is_exact():
    rng = np.random.default_rng(3)
    n = 30
    pairs = rng.integers(0, 9, (n, n)) * (rng.random((n, n)) < 0.3)
    k = rng.integers(1, brown.CLASSES, n)

    def value(k):
        g = np.zeros((brown.CLASSES, brown.CLASSES))
        np.add.at(g, (k[:, None].repeat(n, 1), k[None, :].repeat(n, 0)), pairs)
        return brown._xlogx(g).sum() - brown._xlogx(g.sum(axis=0)).sum() - brown._xlogx(g.sum(axis=1)).sum(), g

    before, g = value(k)
    for u in range(5):
        left, right = (np.bincount(np.delete(k, u), np.delete(x, u), brown.CLASSES) for x in (pairs[:, u], pairs[u]))
        best, gain = brown.best_class(int(k[u]), left, right, float(pairs[u, u]), g)
        moved = k.copy()
        moved[u] = best
        assert abs(value(moved)[0] - before - gain) < 1e-6 and gain >= 0


# addresses


ADDRESSES = [None, "", "http://a.org", "HTTP://A.ORG/x?y", "x://example.ORG/en/12", "x://b.example.org/es/?q", "x://example.org?/es/", "://com/de/", "x://.com/fr/a", "x://a..com/de/x#u", "no", "x://É.org/é/", "x://net.example.net/a"]


@pytest.mark.parametrize("most", [20_000, 2])
def test_url_rules(spark, store, monkeypatch, most):
    monkeypatch.setattr(urls, "BROADCAST_KEYS", most)
    rules = [*URL_RULES, ("net.example.net/a", "block")]
    pages = store([(i or None, u, i, "w") for i, u in enumerate(ADDRESSES * 2)], "page_id long, url string, row int, words string")
    got = urls.url_filter(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect()
    want = [(i or None, *brute.url_verdict(u, rules)) for i, u in enumerate(ADDRESSES * 2)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_url_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("h"), "id", F.lit(".org/")).alias("key"))
    n = -(-5000 * urls.BITS_A_KEY // urls.BLOCK_BITS)
    blocks = urls.bloom_filter(keys, n)
    ask = spark.range(20000).select(F.concat(F.lit("h"), "id", F.lit(".org/")).alias("key"), "id")
    hit = ask.withColumn("block", urls._block(F.col("key"), n)).join(blocks, "block").filter(urls.may_hold(F.col("words"), F.col("key")))
    r = hit.agg(F.sum((F.col("id") < 5000).cast("int")).alias("old"), F.sum((F.col("id") >= 5000).cast("int")).alias("new")).first()
    assert r["old"] == 5000 and (r["new"] or 0) < 150


def test_url_empty_tables(spark, store):
    none = spark.createDataFrame([], "rule string, verdict string")
    pages = store([(1, "x://a.org/")], "page_id long, url string")
    assert [tuple(r) for r in urls.url_filter(pages, none).collect()] == [(1, "a.org", "/", None, "allow")]
    assert urls.url_filter(pages.limit(0), spark.createDataFrame(URL_RULES, "rule string, verdict string")).count() == 0


# personal data


def test_pii_base_spans(odd, store):
    hard = ["a@b.c_x@d.e", "1.2.3.4.5.6.7.8", "41111111 11111111 4", "@@a@b.c@d.e", "1" * 500, "4111111111111111-4111111111111111", "00010.1.2.3", "..%a@b.c.", "+12345678901234567 +123-456-7890)", "a" * 30000, "1 " * 5000, "a." * 3000 + "@b.c", "1.1.1.1." * 900, "+" * 500 + "1" * 12]
    table = odd.select("doc_id", "text").unionByName(store([(100 + i, t) for i, t in enumerate(hard)], "doc_id long, text string"))
    got = pii.personal_data(table).select("doc_id", pii.digest(F.col("base")).alias("b"), pii.digest(F.col("spans")).alias("s")).collect()
    want = sorted((str(i), brute.digest(brute.base_spans(t))) for i, t in texts_of(table))
    assert sorted((str(r["doc_id"]), r["b"]) for r in got) == want
    assert all(set(filter(None, r["b"].split(","))) <= set(r["s"].split(",")) for r in got)


def test_pii_finds_what_seeds_teach_and_leaves_common_words(store):
    seeds = [(i, f"please dial hotline: +1 (456) 555-21{i:02d} now and see the 7{i:05d} of them") for i in range(12)]
    rows = [*seeds, (50, "the hotline: 456-555-9999 is new"), (51, "the 123456 is a number, of 998877 others")]
    got = {r["doc_id"]: r for r in pii.personal_data(store(rows, "doc_id long, text string")).collect()}
    assert [(s["start"], s["end"], pii.KINDS[s["kind"]]) for s in got[50]["spans"]] == [(13, 25, "phone")]
    assert not got[51]["spans"] and all(len(got[i]["spans"]) == 1 for i in range(12))


def test_pii_mask_keeps_the_rest(odd, nothing):
    got = sorted(str((r["doc_id"], r["text"], r["row"])) for r in pii.masked(odd).collect())

    def mask(text):
        at, out = 0, ""
        for a, _, b, name in brute.base_spans(text):
            if a >= at:
                out += text[at:a] + f"<{name}>"
            at = max(at, b)
        return None if text is None else out + text[at:]

    assert got == sorted(str((r["doc_id"], mask(r["text"]), r["row"])) for r in odd.collect())
    assert pii.masked(nothing).count() == 0 and pii.masked(odd).columns == odd.columns


# top k


def test_top_k_equals_brute_force(store):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * math.exp(rng.gauss(0, 1)) for _ in range(6)], "x") for i in range(900)]
    rows[3], rows[100], rows[200] = (3, None, "x"), (100, [None, 1.0], "x"), (200, [float("nan")] * 6, "x")
    rows[7], rows[8], rows[300] = (7, [1.0] * 3, "x"), (8, [], "x"), (300, [0.0] * 6, "x")
    rows += [(1000 + i, rows[400][1], "y") for i in range(150)] + [(None, [1.0] * 6, "x"), (500, rows[500][1], "x")]
    table = store(rows, "vec_id long, embedding array<float>, norm string")
    got = topk.top_k(table, F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == brute.top_k([r[:2] for r in rows])
    assert topk.top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_pruning_keeps_every_hit():
    rng = np.random.default_rng(4)
    v = (rng.standard_normal((400, 8)) * np.exp(rng.standard_normal((400, 1))) * 500).astype(np.int64)
    b = topk.Block(np.arange(400), np.arange(400), v)
    for _ in range(60):
        q = (rng.standard_normal(8) * 700).astype(np.int64)
        scores = b.vectors @ q
        for t in np.sort(scores)[[-1, -5, -50]].astype(float):
            some = topk.candidates(b, q.astype(float), float(np.sqrt((q**2).sum())), t)
            assert set(np.flatnonzero(scores >= t)) <= set(some.tolist())


# conversations


def chat_cost(roles, targets):
    state, cost = 0, 0
    for role, to in zip(roles, targets, strict=True):
        ways = [chat.MERGE] * (state == to) + ([chat.INSERT * len(chat.INSERTED[state, to])] if chat.INSERTED[state, to] is not None else [])
        if not ways:
            return math.inf
        cost += min(ways) + (0 if role == to else chat.RELABEL if role else chat.NAME)
        state = to
    return cost + chat.INSERT * len(chat.CLOSING[state])


def test_chat_repair_is_cheapest_legal_and_does_not_depend_on_cuts(store, monkeypatch):
    rng = random.Random(6)
    names = ["tool", "system", " User", "assistant"]
    roles = {c: [rng.randrange(4) for _ in range(rng.randint(1, 6))] for c in range(80)}
    rows = [(c, t, names[r], f"{c}.{t}" if t else None, 1) for c, rr in roles.items() for t, r in enumerate(rr)]
    rows += [(None, None, None, "lost", 1), (900, 1, "user", "twice", 1), (900, 1, "user", "twice", 1)]
    table = store(rows, "conv_id long, turn long, role string, text string, no int")
    whole = {r["conv_id"]: r for r in chat.chat_format(table).collect()}
    for c, rr in roles.items():
        assert whole[c]["cost"] == min(chat_cost(rr, t) for t in itertools.product((1, 2, 3), repeat=len(rr)))
        said = [x.split("|>\n")[0] for x in whole[c]["text"].split("<|")[1:]]
        said = said[1:] if said[0] == "system" else said
        assert said == ["user", "assistant"] * (len(said) // 2) and said
        assert all(f"{c}.{t}" in whole[c]["text"] for t in range(1, len(rr)))
    assert whole[900]["text"] == "<|user|>\ntwice\ntwice\n<|assistant|>\n\n" and whole[900]["merged"] == 1
    monkeypatch.setattr(chat, "PIECE", 2)
    cut = {}
    for r in sorted(chat.chat_format(table).collect(), key=lambda r: r["part"]):
        text, cost = cut.get(r["conv_id"], ("", 0))
        cut[r["conv_id"]] = text + r["text"], cost + r["cost"]
    assert cut == {c: (r["text"], r["cost"]) for c, r in whole.items()}
    assert chat.chat_format(table.limit(0)).count() == 0


# near duplicates


def random_copies(rng, n_groups, copies, length, words=4000):
    out = []
    for _ in range(n_groups):
        base = [f"v{rng.randrange(words)}" for _ in range(length)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, length // 25))):
                own[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("k", "t"), [(3, 90), (5, 80)])
def test_jaccard_components(store, odd, k, t, monkeypatch):
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = random_copies(rng, 6, 5, 120) + random_copies(rng, 1, 70, 60) + random_copies(rng, 2, 3, 700)
    texts += [passage + " " + " ".join(f"q{rng.randrange(300)}" for _ in range(rng.randint(0, 80))) for _ in range(60)]
    texts += [texts[0]] * 5 + random_copies(rng, 20, 2, 12, 30)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)  # several blocks to a group
    table = odd.select("doc_id", "text", "key").unionByName(store([(1000 + i, x, "c") for i, x in enumerate(texts)], "doc_id long, text string, key string"))
    rows = [(i, x) for i, x in texts_of(table) if i is not None]
    sets = {i: brute.shingles(x, k) for i, x in rows}
    want = brute.link_components(sets, t)
    got = {r["doc_id"]: r for r in ngram_join.jaccard_components(table, k, t).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items() if i is not None} == {i: (len(sets[i]), want[i]) for i in sets}
    assert got[None]["component_id"] is None
    kept = ngram_join.one_of_each(table, k, t).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted([*(str(i) for i in sets if want[i] == i), "None"])


def test_jaccard_of_nothing(nothing):
    assert ngram_join.jaccard_components(nothing).count() == 0


def test_signatures_meet_for_every_pair_within_the_threshold():
    rng = np.random.default_rng(8)
    for t, size in itertools.product((80, 90), (12, 150, 590, 650, 1500)):
        hot = np.sort(rng.choice(1 << 40, size * 2, replace=False).astype(np.int64))
        for _ in range(4):
            x = np.sort(rng.choice(hot, size, replace=False))
            lost = int(ngram_join.errors(size, t)) // 2
            y = np.union1d(np.delete(x, rng.choice(size, lost, replace=False)), rng.choice(hot, lost, replace=False))
            if 100 * len(np.intersect1d(x, y)) >= t * len(np.union1d(x, y)):
                frequent = np.sort(rng.choice(hot, size, replace=False))
                a, b = (set(ngram_join.combination_signatures(s, np.isin(s, frequent), t)[0].tolist()) for s in (x, y))
                assert a & b


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7 + 100 * i) for i in range(2, 9)] + [(5000, 5000), (6001, 6000)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, *(7 + 100 * i for i in range(2, 9)))} | {6000: 6000, 6001: 6000}


# quality


def test_quality_statistics_and_rules(spark, odd, store, nothing):
    labels = store([(i, i % 2, 0) for i in range(5, 14)] + [(None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(odd, labels).collect()
    want = [(i, *brute.statistics(t)) for i, t in texts_of(odd)]
    assert sorted(map(str, [(r["doc_id"], *(r[c] for c in quality.COUNTS)) for r in got])) == sorted(map(str, want))
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    assert "spans" in got[0] and quality.quality_rules(nothing, labels).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in quality.quality_rules(odd, labels.limit(0)).collect())


def test_quality_on_labelled_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    r = quality.quality_rules(docs, labels).filter("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {x["quality"]: x["kept"] for x in r}
    assert kept[1] >= 0.99 and kept.get(0, 0) < 0.5


def test_trees_keep_directions_and_learn():
    rng = np.random.default_rng(9)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.3)).astype(float)
    m = quality.fit(x, y, [-1, 1, 0])
    held = rng.random((2000, 3))
    assert ((m.probability(held) > 0.5) == ((held[:, 0] < 0.6) & (held[:, 1] > 0.3))).mean() > 0.95
    for f, sign in ((0, -1), (1, 1)):
        line = np.repeat(rng.random((50, 1, 3)), 40, axis=1)
        line[:, :, f] = np.linspace(0, 1, 40)
        p = m.probability(line.reshape(-1, 3)).reshape(50, 40)
        assert (np.diff(p, axis=1) * sign >= -1e-12).all()


# pieces


def every_segmentation(v, word):
    out = []

    def go(at, key, ids):
        if not at:
            out.append((key, ids))
        for j, k, own in v.arcs(word, at) if at else ():
            go(j, key + k, own + ids)

    go(len(word), 0, ())
    return sorted(out)


def test_lattice_equals_enumeration():
    v, rng = lattice.vocabulary(PIECES), random.Random(10)
    parts = ["▁", "a", "th", "e", "ñ", "日", "\t", "\U0001f600", "ing", "\x00"]
    words = list(dict.fromkeys("".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(200)))
    for w, (best, second, ids) in zip(words, v.segment(words), strict=True):
        every = every_segmentation(v, w)
        n = v.n_best(w, 4)
        assert [k for k, _ in n] == [k for k, _ in every[:4]] and best == every[0][0]
        assert second == every[1][0] if len(every) > 1 else second >= int(lattice.NEVER)
        assert np.frombuffer(ids, np.uint32).tolist() == list(n[0][1]) and v._segment_long(w)[::2] == (best, ids)


def test_n_best_of_texts_counts_and_round_trip(store, odd, nothing):
    v = lattice.vocabulary(PIECES)
    rows = [(i, t) for i, t in enumerate([None, "", " ", "a  b", "of the\nfor  an▁x ", "日本\t\n\n", "\x00 "])]
    got = subwords.n_best(store(rows, "doc_id long, text string"), PIECES, 4, check=True).collect()
    for i, t in rows:
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["rank"])
        every = every_segmentation(v, (" " + (t or "")).replace(" ", "▁"))
        assert [(r["cost"], r["n_pieces"]) for r in own] == [(k >> 20, k & subwords.MASK) for k, _ in every[:4]]
        assert all(r["round_trip"] for r in own) and len({bytes(r["ids"]) for r in own}) == len(own)
    counts = {r["doc_id"]: r for r in subwords.token_counts(odd, PIECES).collect()}
    best = subwords.n_best(odd, PIECES, 2)
    for r in best.filter("rank = 1").collect():
        assert (counts[r["doc_id"]]["n_tokens"], counts[r["doc_id"]]["cost"]) == (r["n_pieces"], r["cost"])
    decoded = subwords.decode_ids(best.withColumn("decoded", F.lit(1)), PIECES).collect()
    text = dict(texts_of(odd))
    assert all(r["decoded"] == (text[r["doc_id"]] or "") for r in decoded)
    assert subwords.n_best(nothing, PIECES).count() == 0 and subwords.token_counts(nothing, PIECES).count() == 0


def test_brown_every_word_has_the_class_of_its_neighbours(store):
    """More words than OWN, all of one spelling: each still gets the class of the words that it stands in for, rare ones too."""
    rng = random.Random(5)
    nouns, verbs, rare = [f"n{i}abc" for i in range(600)], [f"v{i}abc" for i in range(600)], [f"r{i}abc" for i in range(20)]
    pairs = list(zip(rng.sample(nouns * 40, 24000), rng.sample(verbs * 40, 24000)))
    rows = [(i, " ".join(f"{n} {v}" for n, v in pairs[i * 100 : i * 100 + 100])) for i in range(240)]
    rows += [(240 + i, f"{rng.choice(nouns)} {w} {rng.choice(nouns)} {rng.choice(verbs)}") for i, w in enumerate(rare * 2)]
    docs = store(rows, "doc_id long, text string")
    words = brown.written(brown.vocabulary(docs), "v")
    own = brown.numbered(words)
    assert set(own) == {b"", *(w.encode() for w in nouns + verbs)}
    assert len(own) > brown.OWN
    pairs = brown.written(brown.unit_bigrams(docs, own), "p")
    first, classes = brown.start(pairs, own), brown.exchange(pairs, own)
    g = brown.class_bigrams(pairs, classes)
    assert brown.likelihood(g) > brown.likelihood(brown.class_bigrams(pairs, first)) + 100
    of = {w: int(classes[own[w.encode()]]) for w in nouns + verbs}
    assert not {of[w] for w in nouns} & {of[w] for w in verbs}
    met = brown.written(brown.rare_words(docs, own, classes), "r")
    joined = brown.written(brown.join_classes(met, g), "j")
    got = {r["word"]: r["k"] for r in joined.collect()}
    assert set(got) == set(rare) and sum(k in {of[w] for w in verbs} for k in got.values()) >= 18
    whole = brown.class_bigrams(pairs, classes, spelling=False) + brown.rare_bigrams(met, joined)
    k = {w.encode(): c for w, c in (of | got).items()} | {b"": 0}
    want = np.zeros_like(whole)
    for _, text in rows:
        line = [0, *(k[w.encode()] for w in text.split()), 0]
        for a, b in itertools.pairwise(line):
            want[a, b] += 1
    assert (whole == want).all()


def test_pii_candidates_of_each_kind(store):
    long = "k" * 70 + "1234"
    text = f"call (743) 555-3824 or card 4111 1111 1111 1112 or ann (at) site (dot) org or bob@ nowhere or key {long} end"
    got = pii.mentions(store([(1, text)], "doc_id long, text string")).first()
    values = {c["value"]: (c["left"], c["right"]) for c in got["candidates"]}
    assert values["(743) 555-3824"] == ("call", "or") and values["4111 1111 1111 1112"] == ("card", "or")
    assert values["ann (at) site (dot) org"] == ("or", "or") and values[long] == ("key", "end")
    assert any(v.startswith("bob@") for v in values)


def test_pii_counts_glued_words_as_their_contexts(store):
    """A label that is never a word of its own is a pattern; a comma that stands alone a few times is none."""
    rows = [(i, f"me tel:+1 (456) 555-2{i:03d}, ok") for i in range(40)] + [(40, "so tel:456-555-9999 ok"), (41, "built in 123456, then , and , this, that, those")]
    rows += [(50 + i, "one, two, three, four, five") for i in range(40)]
    docs = store(rows, "doc_id long, text string")
    got = {r["doc_id"]: [pii.KINDS[s["kind"]] for s in r["spans"]] for r in pii.personal_data(docs).collect()}
    assert got[40] == ["phone"] and got[41] == [] and got[0] == ["phone"]


def test_pii_marks_found_values_everywhere_and_learns_from_them(store):
    rows = [(i, f"dial +1 (456) 555-2{i:03d} x{i}") for i in range(20)] + [(20 + i, f"dial 456-555-90{i:02d} alsoreach") for i in range(6)]
    rows += [(30, "y 456-777-1234 alsoreach"), (31, "nothing here but 456-777-1234 z"), (32, "plain 456-555-9003 q")]
    got = {r["doc_id"]: [pii.KINDS[s["kind"]] for s in r["spans"]] for r in pii.personal_data(store(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == ["phone"] for i in range(33) if i in got)



def test_urls_keep_long_rules(spark, store):
    path = "/" + "a" * 3000
    pages = store([(1, f"http://x.org{path}/b"), (2, "http://x.org/c")], "page_id long, url string")
    rules = spark.createDataFrame([("x.org/", "allow"), (f"x.org{path}", "block")], "rule string, verdict string")
    got = {r["page_id"]: r["verdict"] for r in urls.url_filter(pages, rules).collect()}
    assert got == {1: "block", 2: "allow"}


@pytest.fixture
def many_files(spark, tmp_path):
    """A table of 24 files whose numbering changes with the smallest number of partitions that a scan makes."""
    texts = [f"note {i} write to user{i}@mail{i % 7}.org or call +1 555 010 {i:04d} {' '.join(f'w{i % 90}.{j}' for j in range(30))}" for i in range(240)]
    rows = [(i % 200, t, "en", f"http://h{i}.org/es/{i}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, url string").repartition(24).write.parquet(str(tmp_path / "t"))
    return str(tmp_path / "t")


def test_rows_keep_their_identity_when_the_cluster_changes(spark, many_files, monkeypatch):
    from barspark.llm import common, ngram_join, pii, urls

    def wrapped(module):
        plain = common.written

        def written(df, name):
            made = plain(df, name)  # between any two reads the splits change
            n = int(spark.conf.get("spark.sql.files.minPartitionNum", "1"))
            spark.conf.set("spark.sql.files.minPartitionNum", str(n % 30 + 9))
            return made

        monkeypatch.setattr(module, "written", written)

    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        docs = spark.read.parquet(many_files)
        want = [sorted(map(tuple, pii.masked(docs).collect())), sorted(map(tuple, urls.url_filter(docs.withColumnRenamed("doc_id", "page_id"), spark.createDataFrame([("org/es/1", "block")], "rule string, verdict string")).collect()), key=repr)]
        assert not any("@" in r[1] for r in want[0])
        n = ngram_join.one_of_each(docs).count()
        for module in (pii, urls, ngram_join):
            wrapped(module)
        assert sorted(map(tuple, pii.masked(docs).collect())) == want[0]
        assert sorted(map(tuple, urls.url_filter(docs.withColumnRenamed("doc_id", "page_id"), spark.createDataFrame([("org/es/1", "block")], "rule string, verdict string")).collect()), key=repr) == want[1]
        assert ngram_join.one_of_each(docs).count() == n
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_bitmaps_refuse_no_link_and_most_strangers():
    rng = np.random.default_rng(7)
    refused = 0
    for case in range(400):
        t = int(rng.choice([80, 90, 95]))
        size = int(rng.choice([12, 64, 300, 1024, 1025, 5000]))
        pool = np.unique(rng.integers(-(2**63), 2**63 - 1, size * 2))
        rng.shuffle(pool)
        lost = int(rng.integers(0, size // 4 + 1)) if case % 2 else size
        x, y = pool[:size], np.concatenate([pool[lost:size], pool[size : size + int(rng.integers(0, max(lost, 1) + 1))]])
        if not len(y):
            continue
        linked = 100 * len(np.intersect1d(x, y)) >= t * len(np.union1d(x, y))
        passed = ngram_join.may_link(ngram_join.bitmap(np.sort(x)), ngram_join.bitmap(np.sort(y)), len(x), len(y), t)
        assert passed == ngram_join.may_link(ngram_join.bitmap(y), ngram_join.bitmap(x), len(y), len(x), t)
        assert passed or not linked
        refused += not passed and lost == size
    assert refused > 150
