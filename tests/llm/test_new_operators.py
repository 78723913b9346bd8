"""Whitening, mixing and the filter audit against plain versions."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from barspark.llm import interplay, mixing, whiten


def plain_whitening(vectors, k=16):
    rows = [(i, v) for i, v in vectors if v is not None and len(v) and all(e is not None and np.isfinite(e) for e in v)]
    common = max(Counter(len(v) for _, v in rows).items(), key=lambda x: (x[1], x[0]))[0]
    rows = [(i, v) for i, v in rows if len(v) == common]
    x = [[int(np.floor(64.0 * float(np.float32(e)))) + 1000000 for e in v] for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centre = lambda r: [float(n * a - b) / n for a, b in zip(r, s, strict=True)]
    c = np.array([centre(r) for r in fit])
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    y = np.array([centre(r) for r in x]) @ q
    return [i for i, _ in rows], n, deviation, y, e


def vectors(rng, n, d):
    made = [[float(np.float32(v)) for v in rng.normal(size=d) * np.arange(1, d + 1)] for _ in range(n)]
    return made + [made[3]] * 40  # copies


@pytest.mark.parametrize("small", [False, True])
def test_whitening_equals_numpy(store, monkeypatch, small):
    if small:  # many blocks of rows and of columns, and a split middle dimension
        for name, value in (("BLOCK_BYTES", 8 * 20 * 7), ("WIDTH", 6), ("SPLIT", 2)):
            monkeypatch.setattr(whiten, name, value)
    rng = np.random.default_rng(5)
    data = list(enumerate(vectors(rng, 150, 20)))
    data += [(None, data[0][1]), (900, None), (901, []), (902, [1.0] * 19 + [None]), (903, [float("nan")] * 20), (904, [float("inf")] * 20), (905, [1.0, 2.0])]
    table = store([(i, v, 1, "x", 0.5) for i, v in data], "vec_id long, embedding array<float>, n int, rows string, x double", parts=5)
    made = whiten.whiten(table)
    got = made.rows.collect()
    ids, n, deviation, y, e = plain_whitening(data)
    key = lambda i, dev: (-1 if i is None else i, dev)
    got = sorted(got, key=lambda r: key(r["id"], r["deviation"]))
    order = sorted(range(len(ids)), key=lambda r: key(ids[r], deviation[r]))
    assert made.n == n and [r["id"] for r in got] == [ids[i] for i in order] and [r["deviation"] for r in got] == [deviation[i] for i in order]
    want, have = y[order] / np.sqrt(e), np.array([r["whitened"] for r in got])
    assert have.shape[1] == 16
    np.testing.assert_allclose(have * np.sign((have * want).sum(0)), want, atol=1e-9)
    assert made.identity_error < 1e-9 and abs(sum(made.explained) - 1) < 0.2


def test_whitening_of_odd_tables(store, spark):
    schema = "vec_id long, embedding array<float>"
    empty = whiten.whiten(store([], schema))
    assert empty.rows.collect() == [] and empty.n == 0
    one = whiten.whiten(store([(1, [1.0, 2.0]), (1, [1.0, 2.0])], schema))
    assert [tuple(r) for r in one.rows.collect()] == [(1, 0, [None, None])] * 2 and one.identity_error == 0.0 and one.explained == [None, None]
    flat = whiten.whiten(store([(i, [float(i), float(2 * i), 7.0]) for i in range(10)], schema))  # one direction only
    rows = flat.rows.collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] for r in rows) and flat.identity_error < 1e-9
    huge = whiten.whiten(store([(i, [1e38 * (i % 3), 3.0e17 + i]) for i in range(6)], schema))
    assert {r["deviation"] for r in huge.rows.collect()} == {None}


def plain_masks(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = {}
    for i, t, source in docs:
        t = t or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t])
        mask = sum(f << b for b, f in enumerate(fails))
        good, toxic = (any(x[k] == 1 for x in labels if x[0] == i and i is not None) for k in (1, 2))
        at = out.setdefault((source or "", mask), [0, 0, 0])
        for k, v in enumerate((1, good, toxic)):
            at[k] += v
    return out


def plain_audit(counts):
    rows, total = {}, Counter()
    for order in itertools.permutations("ABCDE"):
        left = dict(counts)
        for step, f in enumerate(order):
            bit = 1 << "ABCDE".index(f)
            gone = {m: c for m, c in left.items() if m & bit}
            left = {m: c for m, c in left.items() if not m & bit}
            n = [sum(c[k] for c in gone.values()) for k in range(3)]
            total[f] += n[0]
            rows["".join(order), step + 1] = [sum(c[0] for c in left.values()), n[0], sum(c[0] for m, c in counts.items() if m & bit) - n[0], counts.get(bit, (0,))[0], n[1], n[2], f]
    return {(*k, *v[:-1], total[v[-1]]) for k, v in rows.items()}


def test_exchanges_visit_every_order():
    for n in range(1, 6):
        order, seen = list(range(n)), []
        for move in [None, *interplay.exchanges(n)]:
            if move is not None:
                order[move], order[move + 1] = order[move + 1], order[move]
            seen.append(tuple(order))
        assert sorted(seen) == list(itertools.permutations(range(n)))


def test_diagrams_equal_plain_filtering():
    rng = random.Random(3)
    for size in (0, 1, 2, 7, 31, 32):
        counts = {m: (rng.randint(1, 3), rng.randint(0, 1), rng.randint(0, 1)) for m in rng.sample(range(32), size)}
        assert set(interplay.audited(counts)) == plain_audit(counts)


def test_equal_nodes_are_shared():
    diagram = interplay.Diagram({m: (1, 0, 0) for m in range(32)})
    assert [len(level) for level in diagram.levels] == [1] * 5
    for move in interplay.exchanges(5):
        diagram.exchange(move)
        assert [len(level) for level in diagram.levels] == [1] * 5


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_of_odd_documents(store, seed):
    rng = random.Random(seed)
    texts = [None, "", " \t ", "word " * 250, "Word " * 250, " ".join(f"w{i}" for i in range(300)), "# few", "TWO CAPS", "long " * 50000 + "#", "é ü " * 90]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "a", "b"])) for _ in range(150)]
    docs += docs[:20]
    labels = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(40)]
    got = interplay.audit(
        store([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, part string, mask int"),
        store([(*x, 9) for x in labels], "doc_id long, quality int, toxic int, n int"),
    ).collect()
    want, parts = plain_masks(docs, labels), {d[2] or "" for d in docs}
    for part in parts:
        counts = {m: tuple(c) for (p, m), c in want.items() if p == part}
        assert {tuple(r)[1:] for r in got if r["part"] == part} == plain_audit(counts)
    assert len(got) == 600 * len(parts)


def test_audit_of_an_empty_table(nothing, store):
    assert interplay.audit(nothing, store([], "doc_id long, quality int, toxic int")).collect() == []


def sources(seed, n, most=400):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{i}.{j}" for j in range(rng.randint(0, most))), "big" if i % 3 else rng.choice([None, "", "b", "c", "é"])) for i in range(n)]


SCHEMA = "doc_id long, text string, source string, no int, slot string"


def test_mix_meets_targets_and_holds_whole_blocks(store):
    docs = sources(4, 400)
    docs += [(None, "a b c " * 40, "b"), (7, "again " * 33, "b"), docs[5], (401, None, None), (402, " \n", "only empty"), (403, "tiny text", "few")]
    made = mixing.mix(store([(*d, 1, "s") for d in docs], SCHEMA, parts=7), text=True)
    rows = mixing.taken(made).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len((t or "").split())) for i, t, _ in docs)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    pieces = made.pieces.collect()
    by_source = {r["no"]: r for r in made.sources.collect()}
    assert [by_source[i]["source"] for i in sorted(by_source)] == ["", "b", "big", "c", "few", "only empty", "é", None]
    total = sum(r["source_size"] for r in by_source.values())
    assert abs(sum(r["target"] for r in by_source.values()) - 1.5 * total) < 1e-6 * total
    for no, r in by_source.items():
        took = sum(p["length"] for p in pieces if p["no"] == no)
        assert r["target"] <= 2 * r["source_size"] and abs(took - r["target"]) <= 1.5 * mixing.BLOCK
        assert took == sum(x["taken"] for x in rows if x["source_size"] == r["source_size"] and x["target"] == r["target"])
    # slots are whole, words are the documents' own, a block comes at most twice, and no slot number is missing
    text = {}
    for i, t, _ in docs:
        text.setdefault(i, set()).add(tuple((t or "").split()))
    slots = {}
    for p in pieces:
        assert any(tuple(p["words"]) == w[p["start"] : p["start"] + p["length"]] for w in text[p["doc_id"]])
        slots.setdefault(p["slot"], []).append(p)
    assert sorted(slots) == list(range(sum(r["slots"] for r in by_source.values())))
    for parts in slots.values():
        assert len({(p["no"], p["turn"], p["block"]) for p in parts}) == 1
        no, block = parts[0]["no"], parts[0]["block"]
        assert sum(p["length"] for p in parts) == min(mixing.BLOCK, by_source[no]["source_size"] - block * mixing.BLOCK)
    assert max(Counter((s[0]["no"], s[0]["block"]) for s in slots.values()).values()) <= 2
    assert len({(s[0]["no"], s[0]["turn"], s[0]["block"]) for s in slots.values()}) == len(slots)  # each turn permutes


def test_mix_does_not_depend_on_the_files(store, monkeypatch):
    docs = [(*d, 1, "s") for d in sources(9, 200)]
    first = sorted(map(tuple, mixing.taken(mixing.mix(store(docs, SCHEMA, parts=1))).collect()), key=repr)
    monkeypatch.setattr(mixing, "FEW", 0)  # and by the salted join
    assert first == sorted(map(tuple, mixing.taken(mixing.mix(store(docs[::-1], SCHEMA, parts=9))).collect()), key=repr)


def test_shards_are_multinomial(store):
    made = mixing.mix(store([(*d, 1, "s") for d in sources(2, 1500)], SCHEMA), block=1)
    n = made.sources.agg({"slots": "sum"}).first()[0]
    counts = made.pieces.filter(f"shard < {n // mixing.SHARD}").groupBy("shard", "no").count().toPandas()
    plan = {r["no"]: r["slots"] / n for r in made.sources.collect()}
    table = counts.pivot(index="shard", columns="no", values="count").fillna(0)
    chi = sum(((table[no] - mixing.SHARD * p) ** 2 / (mixing.SHARD * p)).sum() for no, p in plan.items())
    freedom = len(table) * (len(plan) - 1)
    assert abs(chi - freedom) < 6 * (2 * freedom) ** 0.5  # neither too even nor too uneven


def test_mix_of_nothing(nothing, store):
    assert mixing.taken(mixing.mix(nothing)).collect() == []
    blank = mixing.taken(mixing.mix(store([(1, None, None, 1, "s"), (2, " ", "a", 1, "s")], SCHEMA))).collect()
    assert sorted(tuple(r) for r in blank) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_large_groups_are_verified_whole(store, monkeypatch):
    """One coarse group of near copies and unrelated sets: every link between blocks, outsiders and waves is found, none is made up."""
    from barspark.llm import ngram_join
    from tests.llm import brute

    for name, value in (("BLOCK", 8), ("WAVE", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(6)
    sets = {}
    for family in range(9):
        base = [family * 10000 + j for j in range(60)]
        for _ in range(rng.choice([1, 2, 30])):
            sets[len(sets)] = sorted(set(base) - set(rng.sample(base, rng.randint(0, 4))) | {rng.randrange(1 << 40) for _ in range(rng.randint(0, 3))})
    groups = store([(node, 0, tokens) for node, tokens in sets.items()], "node long, g long, tokens array<long>")
    links = [tuple(r) for r in ngram_join.verified(groups, 90).collect()]
    for a, b in links:
        shared = len(set(sets[a]) & set(sets[b]))
        assert 100 * shared >= 90 * (len(sets[a]) + len(sets[b]) - shared)
    want = brute.link_components({n: set(s) for n, s in sets.items()}, 90)
    parent = {n: n for n in sets}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert {n: root(n) for n in sets} == want
