"""Plain versions of the operators, for small inputs."""

import itertools
import math
import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def shingles(text, k):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def link_components(sets, t):
    """{key: set} to {key: least key linked}; all pairs."""
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= t * len(x | y):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, (name, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": True, "ip": name != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15,
            }[name]
            if fine:
                out.append((m.start(), k, m.end(), name))
    return sorted(out)


def digest(spans):
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in spans)


def base_scores(texts, train):
    """[(n_tokens, n_known, total, base)] of the texts; ``train``: which ones teach."""
    tokens = [[*WORD.findall(lower(t)), None] for t in texts]
    c = Counter(w for t, use in zip(tokens, train, strict=True) if use for w in t)
    n, v = sum(c.values()), len(c)
    return [(len(t), sum(w in c for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for t in tokens]


def top_k(rows, k=10):
    """rows: [(vec_id, vector)]; queries have ids divisible by 100."""
    fine = [(i, v) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in fine), default=0)
    ints = [[math.floor(1024 * float(np.float32(c))) for c in v] + [0] * (width - len(v)) for _, v in fine]
    out = []
    for a, (i, _) in enumerate(fine):
        if i % 100 == 0:
            got = sorted((-sum(x * y for x, y in zip(ints[a], ints[b], strict=True)), fine[b][0], b) for b in range(len(fine)) if b != a)[:k]
            out += [(i, r, j, -s) for r, (s, j, _) in enumerate(got, 1)]
    return sorted(out)


def url_verdict(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    path, host = re.match("[^?#]*", rest[len(host) :]).group(), lower(host)
    fits = [(len(r), r, v) for r, v in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    _, rule, verdict = max(fits) if fits else (0, None, default)
    return host, path, rule, verdict
