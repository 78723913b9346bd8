"""Pieces of a SentencePiece vocabulary as a lattice over pre-tokens: trie-shared dynamic programming and N-best search.

A text is a blank and the text, with blanks shown as U+2581, cut into pre-tokens: runs of blanks with the word behind them, words
after a line feed, and line feeds. No piece crosses those cuts (pieces with a blank behind another character or with a line feed
take no part), so the best segmentation of a text is made of its pre-tokens' best ones. A character without a piece is spelled
by its bytes' pieces.

Scores are integers, thousandths of a nat, so that ties are exact: pieces follow Zipf's law by their rank in the vocabulary, a
byte costs ten nats more than the rarest piece. Of equal segmentations the one of fewer pieces wins, then the one whose last
piece is longer, then the one before, and so on.

Distinct pre-tokens are sorted, which lines up their trie: a node is the first of a run of words that share a prefix. Forward
scores (best and second best) are computed level by level for all nodes at once, so once for each shared prefix; a word ends
at a terminal node, where its score, count and pieces are stored.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np

PRE_TOKEN = re.compile(" +[^ \n]*|[^ \n]+|\n")
BLANK = "▁"
#: A key is cost * 2**20 + number of pieces: comparing keys compares both.
PIECE = 1 << 20
NEVER = np.int64(1) << np.int64(61)
LONGEST_IN_TRIE = 48
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_MULTIPLIERS = tuple(_U(pow(0x5851F42D4C957F2D, i, 1 << 64)) for i in range(1, 12))


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and BLANK not in self.pieces[i].lstrip(BLANK) and "\n" not in self.pieces[i]]
        total = np.log(sum(1 / (r + 10) for r in range(1, len(usable) + 1)))
        self.cost = {self.pieces[i]: (round(1000 * float(np.log(r + 10) + total)), i) for r, i in enumerate(usable, 1)}
        self.byte_cost = round(1000 * float(np.log(len(usable) + 10) + total + 10))
        self.longest = max(map(len, self.cost))
        h = np.array([int(self.hashes(np.array([[ord(c) + 1 for c in p]]))[0, -1]) for p in self.cost], _U)
        order = np.argsort(h)
        self.sorted_hashes = h[order]
        self.sorted_keys = np.array([c for c, _ in self.cost.values()], np.int64)[order] * PIECE + 1
        self.sorted_ids = np.array([i for _, i in self.cost.values()], np.int64)[order]
        # two direct tables by 21 bits of multiplied hashes: the second holds what meets another piece in the first
        self.high, self.low = np.zeros(1 << 21, np.int32), np.zeros(1 << 21, np.int32)
        slot = self._slot(self.sorted_hashes, _MULTIPLIERS[0])
        _, first = np.unique(slot, return_index=True)
        self.high[slot[first]] = first
        rest = np.setdiff1d(np.arange(len(slot)), first)
        self.second = next((m for m in _MULTIPLIERS[1:] if len(np.unique(self._slot(self.sorted_hashes[rest], m))) == len(rest)), None)
        if self.second is not None:
            self.low[self._slot(self.sorted_hashes[rest], self.second)] = rest

    @staticmethod
    def _slot(h: np.ndarray, multiplier: np.uint64) -> np.ndarray:
        return ((h * multiplier) >> _U(43)).astype(np.int64)

    @staticmethod
    def hashes(chars: np.ndarray) -> np.ndarray:
        """Hashes of all prefixes of each row of code points plus one."""
        out = np.zeros((chars.shape[0], chars.shape[1] + 1), _U)
        for j in range(chars.shape[1]):
            out[:, j + 1] = out[:, j] * _BASE + chars[:, j].astype(_U)
        return out

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are a piece's, and those pieces' places in the sorted tables."""
        if self.second is None:
            at = np.minimum(np.searchsorted(self.sorted_hashes, h), len(self.sorted_hashes) - 1)
        else:
            at = self.high[self._slot(h, _MULTIPLIERS[0])]
            missed = np.flatnonzero(self.sorted_hashes[at] != h)
            at[missed] = self.low[self._slot(h[missed], self.second)]
        hit = np.flatnonzero(self.sorted_hashes[at] == h)
        return hit, at[hit]

    def arcs(self, text: str, end: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """(begin, key, ids) of the pieces that end at ``end``."""
        out = []
        for j in range(max(0, end - self.longest), end):
            hit = self.cost.get(text[j:end])
            if hit:
                out.append((j, hit[0] * PIECE + 1, (hit[1],)))
        if text[end - 1] not in self.cost:
            raw = text[end - 1].encode("utf-8", "surrogatepass")
            out.append((end - 1, len(raw) * (self.byte_cost * PIECE + 1), tuple(self.bytes[b] for b in raw)))
        return out

    def forward(self, text: str) -> list[int]:
        """Best keys of all prefixes of one word."""
        f = [0]
        for end in range(1, len(text) + 1):
            f.append(min(f[j] + key for j, key, _ in self.arcs(text, end)))
        return f

    def n_best(self, text: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """(key, ids) of the n best segmentations: A* from the end of the word, with forward scores as exact heuristics."""
        f = self.forward(text)
        heap: list = [(f[-1], (), len(text), 0, ())]
        out = []
        while heap and len(out) < n:
            _, path, at, behind, ids = heapq.heappop(heap)
            if at == 0:
                out.append((behind, ids))
                continue
            for j, key, own in self.arcs(text, at):
                heapq.heappush(heap, (f[j] + key + behind, (*path, j), j, behind + key, own + ids))
        return out

    def segment(self, words: list[str]) -> list[tuple[int, int, bytes]]:
        """(best key, second best key, ids of the best as little-endian uint32) of each word, in the order of ``words``."""
        out: dict[str, tuple[int, int, bytes]] = {}
        short = sorted(w for w in words if 0 < len(w) <= LONGEST_IN_TRIE)
        for i in range(0, len(short), 20_000):
            self._segment_trie(short[i : i + 20_000], out)
        for w in words:
            if w not in out:
                best = self._segment_long(w)
                out[w] = best
        return [out[w] for w in words]

    def _segment_long(self, w: str) -> tuple[int, int, bytes]:
        """A word too long for the trie: plain dynamic programming over its characters."""
        f1, f2, back = [0], [int(NEVER)], [(0, ())]
        for end in range(1, len(w) + 1):
            m1 = m2 = int(NEVER)
            way = None
            for j, key, ids in self.arcs(w, end):
                a, b = f1[j] + key, f2[j] + key
                if a < m1:
                    m1, m2, way = a, min(m1, b), (j, ids)
                else:
                    m2 = min(m2, a, b)
            f1.append(m1)
            f2.append(min(m2, int(NEVER)))
            back.append(way)
        ids, at = [], len(w)
        while at:
            at, own = back[at]
            ids.append(own)
        flat = [i for own in reversed(ids) for i in own]
        return f1[-1], f2[-1], np.array(flat, np.uint32).tobytes()

    def _segment_trie(self, words: list[str], out: dict) -> None:
        n = len(words)
        size = np.array([len(w) for w in words])
        width = int(size.max())
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1  # 0 fills up
        chars = np.zeros((n, width), np.int64)
        chars[np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        same = np.zeros(n, np.int64)  # characters shared with the word before
        if n > 1:
            differs = chars[1:] != chars[:-1]
            same[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        prefix = self.hashes(chars)
        power = [_U(pow(int(_BASE), i, 1 << 64)) for i in range(width + 1)]
        index = np.arange(n)
        node_of = np.zeros((width + 1, n), np.int32)  # the first word of the run that shares a prefix of this length
        f1, f2 = np.full((width + 1, n), NEVER), np.full((width + 1, n), NEVER)
        back = np.zeros((width + 1, n), np.int8)
        piece = np.zeros((width + 1, n), np.int32)  # -1: spelled by bytes
        f1[0] = 0
        code_bytes = 1 + (chars > 0x80) + (chars > 0x800) + (chars > 0x10000)
        for d in range(1, width + 1):
            new = (same < d) & (size >= d)
            node_of[d] = np.maximum.accumulate(np.where(new | (same < d), index, 0))
            nodes = index[new]
            m1, m2 = np.full(len(nodes), NEVER), np.full(len(nodes), NEVER)
            way, ids = np.zeros(len(nodes), np.int8), np.zeros(len(nodes), np.int32)
            for j in range(max(0, d - self.longest), d):
                hit, at = self.find(prefix[nodes, d] - prefix[nodes, j] * power[d - j])
                key, own = self.sorted_keys[at], self.sorted_ids[at]
                if j == d - 1:  # a character without a piece is spelled
                    every = code_bytes[nodes, j].astype(np.int64) * (self.byte_cost * PIECE + 1)
                    names = np.full(len(nodes), -1)
                    every[hit], names[hit] = key, own
                    hit, key, own = np.arange(len(nodes)), every, names
                if not len(hit):
                    continue
                parent = node_of[j][nodes[hit]]
                a, b, c1, c2 = f1[j][parent] + key, f2[j][parent] + key, m1[hit], m2[hit]
                better = a < c1
                m2[hit] = np.where(better, np.minimum(c1, b), np.minimum(np.minimum(c2, a), b))
                m1[hit] = np.where(better, a, c1)
                way[hit[better]], ids[hit[better]] = j, own[better]
            f1[d][nodes], f2[d][nodes], back[d][nodes], piece[d][nodes] = m1, m2, way, ids
        # terminal nodes: stored scores, and all words' pieces from the end backwards
        at = size.copy()
        best, second = f1[size, node_of[size, index]], np.minimum(f2[size, node_of[size, index]], NEVER)
        taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            live = np.flatnonzero(at > 0)
            if not len(live):
                break
            node = node_of[at[live], live]
            taken.append((live, piece[at[live], node], at[live] - 1))
            at[live] = back[at[live], node]
        lists: list[list[int]] = [[] for _ in range(n)]
        for live, own, end in reversed(taken):
            for i, p, e in zip(live.tolist(), own.tolist(), end.tolist(), strict=True):
                if p >= 0:
                    lists[i].append(p)
                else:
                    lists[i] += [self.bytes[x] for x in words[i][e].encode("utf-8", "surrogatepass")]
        for w, a, b, ids in zip(words, best.tolist(), second.tolist(), lists, strict=True):
            out[w] = (a, b, np.array(ids, np.uint32).tobytes())


@lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pre_tokens(text: str | None) -> list[str]:
    return PRE_TOKEN.findall(" " + (text or "").replace(BLANK, " "))
