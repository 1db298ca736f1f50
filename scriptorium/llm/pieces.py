"""Cut texts into pieces that tokenisers treat independently, and keep the pieces' ids in a bounded store.

A cut stands before each blank that a word follows: a pre-token never goes over such a place. Texts without double or
final blanks are cut by Arrow's split; the others by a pattern. Arrow finds the distinct pieces of a batch, so that the
store is asked once for each, and numpy lays their ids out in the order of the texts. The store has two generations: when the young one is
full it becomes the old one, so pieces that are met again stay and rare ones go.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode White_Space, which is what \s means in the byte-level pre-tokeniser.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
KEPT = 900_000
#: Pieces that are laid out at once.
BLOCK = 1 << 18
LONGEST = 48


def strings(values: pa.LargeStringArray) -> list[str]:
    """The values as Python strings, split from one text, which is much faster than one by one."""
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(values)], values), pa.scalar("\0", values.type))[0].as_py()
    found = joined.split("\0")
    return found if len(found) == len(values) else values.to_pylist()  # none, or one that holds the mark itself


class Pieces:
    """encode_many turns pieces into their ids as bytes of dtype; ids(texts) gives those of each text as one array."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], dtype: np.dtype, kept: int = KEPT):
        self.encode_many, self.dtype, self.half = encode_many, dtype, kept // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _of(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        young, old = self.young, self.old
        new = set(pieces).difference(young)
        again = old.keys() & new  # goes through the smaller of the two
        young.update(zip(again, map(old.__getitem__, again)))
        fresh = [*filter(None, new.difference(again))]
        young.update(zip(fresh, self.encode_many(fresh), strict=True))
        young[""] = b""  # before a leading blank, and in an empty text
        out = list(map(young.__getitem__, pieces))
        for p in fresh:
            if len(p) > LONGEST:
                del young[p]
        if len(young) > self.half:
            self.old, self.young = young, {}
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        odd = ["  " in t or "\0" in t or t[-1:] == " " for t in texts]
        plain = pa.array([t for t, o in zip(texts, odd) if not o], pa.large_string())
        parts = pc.split_pattern(pc.replace_substring(plain, " ", "\0 "), "\0")
        chunks = [CHUNK.findall(t) for t, o in zip(texts, odd) if o]
        pieces = pa.concat_arrays([parts.flatten(), pa.array([p for c in chunks for p in c], pa.large_string())]).dictionary_encode()
        counts = np.concatenate([pc.list_value_length(parts).to_numpy(zero_copy_only=False), [len(c) for c in chunks]]).astype(np.int64)
        coded = self._of(strings(pieces.dictionary))
        flat = np.frombuffer(b"".join(coded), self.dtype)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        which = pieces.indices.to_numpy()
        laid = [self._laid(flat, starts[w], sizes[w]) for w in (which[i : i + BLOCK] for i in range(0, len(which), BLOCK))]
        ids = np.concatenate(laid) if laid else flat
        before = np.concatenate([[0], np.cumsum(sizes[which])])
        last = np.cumsum(counts)
        order = np.argsort(odd, kind="stable")
        out: list[np.ndarray] = [flat] * len(texts)
        for i, a, b in zip(order.tolist(), before[last - counts].tolist(), before[last].tolist(), strict=True):
            out[i] = ids[a:b]
        return out

    @staticmethod
    def _laid(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """flat[start : start + size] one after the other."""
        ends = np.cumsum(sizes)
        return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]
