"""Deep-shallow sorting of suffixes: multikey quicksort to a shallow depth, then a blind trie for each group that is still equal there."""

from __future__ import annotations

import numpy as np

#: Depth in bytes to which the multikey quicksort goes; it compares 8 bytes at a time.
SHALLOW, STEP = 128, 8
#: Groups up to this size are left to the blind trie at once.
SMALL = 4


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


class BlindTrie:
    """A trie that keeps branching bytes only. A suffix goes down blindly to a leaf, is compared with it once, and joins where they part.

    A node is [depth, {byte at depth: child}]; a leaf is [-1, members]. The end of a suffix branches as -1, before all bytes.
    """

    def __init__(self, suffixes: list[bytes]):
        self.suffixes, self.root = suffixes, None
        for i in range(len(suffixes)):
            self._insert(i)

    @staticmethod
    def _byte(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def _insert(self, i: int) -> None:
        s, leaf = self.suffixes[i], [-1, [i]]
        if self.root is None:
            self.root = leaf
            return
        node = self.root
        while node[0] >= 0:
            node = node[1].get(self._byte(s, node[0])) or next(iter(node[1].values()))
        other = self.suffixes[node[1][0]]
        depth = common(s, other)
        if depth == len(s) == len(other):
            node[1].append(i)
            return
        above, node = None, self.root
        while 0 <= node[0] < depth:
            above, node = node, node[1][self._byte(s, node[0])]
        if node[0] == depth:
            node[1][self._byte(s, depth)] = leaf
            return
        fork = [depth, {self._byte(other, depth): node, self._byte(s, depth): leaf}]
        if above is None:
            self.root = fork
        else:
            above[1][self._byte(s, above[0])] = fork

    def order(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            depth, below = stack.pop()
            if depth < 0:
                out += below
            else:
                stack += [below[b] for b in sorted(below, reverse=True)]
        return out


def sort_suffixes(suffixes: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the suffixes (a shorter one comes before a longer one that it begins), and the common prefix of each with the one before it (the first: 0)."""
    if not suffixes:
        return [], []
    lengths = np.array([len(s) for s in suffixes], np.int64)
    width = -(-max(1, min(shallow, int(lengths.max()))) // STEP) * STEP
    words = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in suffixes), ">u8").reshape(len(suffixes), -1).astype(np.uint64)
    order: list[int] = []
    groups = [(np.arange(len(suffixes)), 0, False)]
    while groups:  # the least group is on top
        members, depth, deep = groups.pop()
        if deep or depth >= width or len(members) <= SMALL:
            order += members[BlindTrie([suffixes[i][depth:] for i in members]).order()].tolist()
            continue
        keys = words[members, depth // STEP]
        pivot = np.partition(keys, len(keys) // 2)[len(keys) // 2]
        less, same, more = members[keys < pivot], members[keys == pivot], members[keys > pivot]
        # where a suffix ends within these bytes, padding hides its length, and the trie must tell
        ended = (lengths[same] < depth + STEP).any()
        groups += [g for g in ((more, depth, False), (same, depth + STEP * (not ended), ended), (less, depth, False)) if len(g[0])]
    return order, [0] + [common(suffixes[a], suffixes[b]) for a, b in zip(order, order[1:])]
