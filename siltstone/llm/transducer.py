"""A minimal acyclic transducer from words (bytes) to lists of ids.

The automaton shares prefixes and suffixes. Each arc carries how many words of the lexicon come
before those it leads to, so the sum along an accepted path is the word's rank; the rank points
into one flat array of ids. As ids hang on ranks, not on states, they hinder no sharing of
suffixes. Everything lies in one file of plain arrays, which tasks map into memory; lookups run
over a whole column of words at a time.
"""

from __future__ import annotations

import numpy as np

_HEAD = 8


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file's bytes; incremental construction over the sorted words."""
    words = sorted(entries)
    # a node is [final, {byte: node}]; `register` holds one node of each kind that is complete
    register: dict[tuple, int] = {}
    kids: list[dict[int, int]] = []
    finals: list[bool] = []
    path: list[list] = [[False, {}]]
    prev = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            sign = (final, tuple(arcs.items()))
            node = register.get(sign)
            if node is None:
                node = register[sign] = len(kids)
                kids.append(arcs)
                finals.append(final)
            path[-1][1][prev[len(path) - 1]] = node

    for w in words:
        same = 0
        while same < min(len(w), len(prev)) and w[same] == prev[same]:
            same += 1
        settle(same)
        path.extend([False, {}] for _ in w[same:])
        path[-1][0] = True
        prev = w
    settle(0)
    root = len(kids)
    kids.append(path[0][1])
    finals.append(path[0][0])

    below = np.zeros(len(kids), dtype=np.int64)  # words from a node on; children come before parents
    keys, to, add = [], [], []
    for n, arcs in enumerate(kids):
        count = int(finals[n])
        for byte, child in sorted(arcs.items()):
            keys.append(n << 8 | byte)
            to.append(child)
            add.append(count)
            count += int(below[child])
        below[n] = count
    ids = [entries[w] for w in words]
    starts = np.cumsum([0, *map(len, ids)])
    parts = [
        np.asarray([root, len(keys), len(kids), len(words), starts[-1], 0, 0, 0], dtype=np.int64),
        np.asarray(keys, dtype=np.int64),
        np.asarray(to, dtype=np.int64),
        np.asarray(add, dtype=np.int64),
        np.asarray(finals, dtype=np.int64),
        starts.astype(np.int64),
        np.asarray([i for x in ids for i in x], dtype=np.int64),
    ]
    return b"".join(p.tobytes() for p in parts)


class Transducer:
    def __init__(self, data):
        a = np.frombuffer(data, dtype=np.int64)
        self.root, arcs, nodes, words, flat = map(int, a[:5])
        cuts = np.cumsum([_HEAD, arcs, arcs, arcs, nodes, words + 1, flat])
        self.keys, self.to, self.add, self.final, self.starts, self.ids = (a[cuts[i] : cuts[i + 1]] for i in range(6))

    def ranks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rank of each word data[starts[i]:ends[i]], -1 if the lexicon has it not."""
        rank = np.zeros(len(starts), dtype=np.int64)
        if not len(self.keys):
            return rank - 1
        state = np.full(len(starts), self.root, dtype=np.int64)
        live = np.flatnonzero(ends > starts)
        at = starts.astype(np.int64).copy()
        while len(live):
            key = (state[live] << 8) | data[at[live]]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[i] == key
            state[live[~ok]] = -1
            live, i = live[ok], i[ok]
            state[live] = self.to[i]
            rank[live] += self.add[i]
            at[live] += 1
            live = live[at[live] < ends[live]]
        known = (state >= 0) & (ends > starts)
        known[known] = self.final[state[known]] == 1
        rank[~known] = -1
        return rank
