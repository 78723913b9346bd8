"""op2: words find their units by hash, and a pass holds one group of bounded size, however many units there are."""

import random
import zlib

import numpy as np
import pyarrow as pa

from barspark.llm import brown
from barspark.llm.common import blocks

SIDE = ["n", "v"]


def text(rng, n=100):
    return " ".join(f"{rng.choice(SIDE)}{rng.randrange(700)}{rng.choice(['abc', 'é', ''])}" for _ in range(n))


def test_units_by_hash_equal_a_dictionary():
    rng = random.Random(3)
    texts = ["", None, " \n", "a", "A b\tcc DDD é éé ÉX"] + [text(rng) + " X" for _ in range(50)]
    split = [(t or "").encode().lower().split() for t in texts]
    some = sorted({w for s in split for w in s})[::2]
    for own in ({b"": 0}, {b"": 0} | {w: 5000 + i for i, w in enumerate(some)}):
        (_, _, words), = blocks(pa.array(texts), True)
        want = [own.get(w, brown.OWN + zlib.crc32(w[-3:]) % brown.SPELLED) for s in split for w in s]
        assert brown.Units(own)(words).tolist() == want and words.per_doc.tolist() == [len(s) for s in split]
        assert brown._strings(words, np.arange(len(want))).to_pylist() == [w.decode() for s in split for w in s]


def test_groups_of_bounded_size_count_every_bigram(store, monkeypatch):
    monkeypatch.setattr(brown, "SHARE", 400)
    rng = random.Random(4)
    rows = [(i, text(rng, i % 40)) for i in range(300)]
    docs = store(rows, "doc_id long, text string")
    own = {b"": 0} | {w: brown.UNITS + i for i, w in enumerate(sorted({w for _, t in rows for w in t.encode().split()})[::3])}
    n = brown.UNITS + len(own) - brown.OWN
    own = {w: u for w, u in own.items() if u < n}
    pairs = brown.written(brown.unit_bigrams(docs, own), "p")
    groups = len(pairs.columns) // 2
    assert groups > brown.GROUPS and -(-n // groups) <= 400
    assert all(len(r[c]) <= 4 * brown.ROW for r in pairs.collect() for c in pairs.columns)

    def counted(k):
        g = np.zeros((brown.CLASSES, brown.CLASSES))
        for _, t in rows:
            units = [0, *(own.get(w, brown.spelled(w)) for w in t.encode().split()), 0]
            np.add.at(g, (k[units[:-1]], k[units[1:]]), 1)
        return g

    draw = np.random.default_rng(1)
    k = np.concatenate([[0], draw.integers(1, brown.CLASSES, n - 1)])
    g = brown.class_bigrams(pairs, k)
    assert (g == counted(k)).all()
    for group in range(groups):
        trial = k.copy()
        mine = np.arange(group, n, groups)[1:]
        trial[mine] = draw.integers(1, brown.CLASSES, len(mine))
        assert (g + brown.moved_bigrams(pairs, k, trial, group) == counted(trial)).all()
    got = brown.offers(pairs, k, g, 1)
    assert len(got) and (got["u"] % groups == 1).all()
    u, to, gain = got[["u", "k", "gain"]].iloc[0]
    trial = k.copy()
    trial[int(u)] = int(to)
    assert abs(brown.likelihood(counted(trial)) - brown.likelihood(g) - gain) < 1e-6
