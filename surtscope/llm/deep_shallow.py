"""Deep-shallow suffix sorting of fixed-length prefixes.

Shallow: an MSD sort with eight-byte words as characters. A pass sorts the
words of all groups that are still tied at once and splits each group at its
changes; equal words stay together for the next word. Deep: groups that share
the whole shallow depth go into one blind trie each. The trie branches on single
bytes, skips what its strings share, and compares each new string once.
"""

from __future__ import annotations

import numpy as np

#: Words that the shallow sort looks at before tries take over.
SHALLOW_WORDS = 3


def _words(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position, most significant first."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | buffer[at + k]
    return out


class BlindTrie:
    """Orders equal-length byte strings; equal ones share a leaf."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # leaf: [-1, first, members]; node: [depth, {byte: child}]

    def insert(self, k: int) -> None:
        s = self.strings[k]
        if self.root is None:
            self.root = [-1, k, [k]]
            return
        node = self.root
        while node[0] >= 0:  # blindly: only branching bytes are looked at
            children = node[1]
            node = children.get(s[node[0]]) or next(iter(children.values()))
        other = self.strings[node[1]]
        if other == s:
            node[2].append(k)
            return
        common = next(i for i, (a, b) in enumerate(zip(s, other)) if a != b)
        parent, byte, node = None, 0, self.root
        while 0 <= node[0] < common:
            parent, byte = node, s[node[0]]
            node = node[1][byte]
        leaf = [-1, k, [k]]
        if node[0] == common:
            node[1][s[common]] = leaf
            return
        fork = [common, {other[common]: node, s[common]: leaf}]
        if parent is None:
            self.root = fork
        else:
            parent[1][byte] = fork

    def leaves(self) -> list[list[int]]:
        """Members of each leaf in the order of their strings."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out.append(node[2])
            else:
                stack.extend(child for _, child in sorted(node[1].items(), reverse=True))
        return out


def sort_prefixes(
    buffer: np.ndarray, at: np.ndarray, group: np.ndarray, length: int, shallow_words: int = SHALLOW_WORDS
) -> tuple[np.ndarray, np.ndarray]:
    """Sort by (group, the ``length`` bytes from ``at``).

    Returns the order and, along it, True where a string differs from the one
    before. ``buffer`` needs eight bytes of padding at its end.
    """
    n = len(at)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    words = min(shallow_words, length // 8)
    order = np.argsort(group, kind="stable")
    first = np.ones(n, bool)
    first[1:] = group[order][1:] != group[order][:-1]
    rank = np.cumsum(first)
    tied = np.arange(n)
    for word in range(words):
        sizes = np.diff(np.r_[np.flatnonzero(first), n])
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(tied):
            return order, first
        members = order[tied]
        w = _words(buffer, at[members] + 8 * word)
        moved = np.lexsort((w, rank[tied]))
        order[tied] = members[moved]
        w, r = w[moved], rank[tied]
        cut = np.zeros(len(tied), bool)
        cut[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
        first[tied] |= cut
        rank = np.cumsum(first)
    starts = np.flatnonzero(first)
    sizes = np.diff(np.r_[starts, n])
    raw, depth = buffer.tobytes(), 8 * words
    for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        members = order[start : start + size].copy()
        tails = [raw[p + depth : p + length] for p in at[members].tolist()]
        if tails.count(tails[0]) == size:
            continue
        trie = BlindTrie(tails)
        for k in range(size):
            trie.insert(k)
        k = start
        for leaf in trie.leaves():
            first[k] = True
            order[k : k + len(leaf)] = members[leaf]
            k += len(leaf)
    return order, first
