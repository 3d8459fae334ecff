"""Words whose common letters with a given one may be enough, found by their common beginnings."""

from __future__ import annotations

import numpy as np

#: Letters of a word that one row of bits holds.
MOST = 62


def _ones(v: np.ndarray) -> np.ndarray:
    return np.bitwise_count(v).astype(np.int64)


class Prefixes:
    """Sorted distinct words as the tree of their beginnings, level by level."""

    def __init__(self, words: list[str], start: int):
        self.words, self.start = words, start
        self.levels, rows, before = [], np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
        size = np.array([len(w) for w in words], dtype=np.int64)
        depth = 0
        while True:
            ends = size[rows] == depth
            n = int(before[-1]) + 1 if len(rows) else 0
            least, most = np.full(n, 1 << 30, dtype=np.int64), np.zeros(n, dtype=np.int64)
            np.minimum.at(least, before, size[rows])
            np.maximum.at(most, before, size[rows])
            word = np.full(n, -1, dtype=np.int64)
            word[before[ends]] = rows[ends]
            rows, parent = rows[~ends], before[~ends]
            letter = np.array([ord(words[r][depth]) for r in rows], dtype=np.int64)
            first = np.ones(len(rows), dtype=bool)
            first[1:] = (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1])
            self.levels.append({"word": word, "least": least, "most": most, "from": np.searchsorted(parent[first], np.arange(n + 1)), "letter": letter[first]})
            if not len(rows):
                return
            before, depth = np.cumsum(first) - 1, depth + 1

    def near(self, asked: list[str], cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in asked, place in words, letters in common) of all pairs whose longest common subsequence, with ``start`` letters before both, makes a ratio of at least the cutoff.

        Row by row of the usual table, each held as bits (a 0 where it grows),
        for all pairs of an asked word and a beginning at once. A beginning goes
        once what it has in common, and all letters still to come, are too few.
        """
        code = {c: i for i, c in enumerate(sorted(set("".join(asked))))}
        mask = np.zeros((len(asked), len(code) + 1), dtype=np.uint64)
        for i, x in enumerate(asked):
            for k, c in enumerate(x):
                mask[i, code[c]] |= np.uint64(1 << k)
        to_code = lambda letters: np.array([code.get(chr(c), len(code)) for c in letters], dtype=np.int64)
        size = np.array([len(x) for x in asked], dtype=np.int64)
        who, node = np.arange(len(asked)), np.zeros(len(asked), dtype=np.int64)
        bits = np.full(len(asked), (1 << (MOST + 1)) - 1, dtype=np.uint64)
        found = []
        for depth, level in enumerate(self.levels):
            a, least, most = size[who] + self.start, level["least"][node] + self.start, level["most"][node] + self.start
            need = lambda b: np.ceil(cutoff * (a + b) / 2 - 1e-9).astype(np.int64)  # noqa: B023, E731
            reach = np.clip(depth + a - need(least), 0, MOST)  # letters further on would leave too many of the asked word out
            inside = (np.uint64(1) << reach.astype(np.uint64)) - np.uint64(1)
            stays = self.start + _ones(~bits & inside) + (most - self.start - depth) >= need(most)
            stays &= (a >= need(least)) & (most >= need(most))
            who, node, bits = who[stays], node[stays], bits[stays]
            word = level["word"][node]
            ends = word >= 0
            if ends.any():
                own = (np.uint64(1) << size[who[ends]].astype(np.uint64)) - np.uint64(1)
                common, b = self.start + _ones(~bits[ends] & own), depth + self.start
                enough = 2 * common >= cutoff * (size[who[ends]] + self.start + b) - 1e-9
                found.append((who[ends][enough], word[ends][enough], common[enough]))
            if depth + 1 == len(self.levels) or not len(who):
                break
            begin, kids = level["from"][node], level["from"][node + 1] - level["from"][node]
            child = np.repeat(begin - np.concatenate(([0], np.cumsum(kids)[:-1])), kids) + np.arange(kids.sum())
            who, bits, node = np.repeat(who, kids), np.repeat(bits, kids), child
            m = mask[who, to_code(np.unique(level["letter"]))[np.searchsorted(np.unique(level["letter"]), level["letter"][child])]]
            u = bits & m
            bits = ((bits + u) | (bits - u)) & np.uint64((1 << (MOST + 1)) - 1)
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
