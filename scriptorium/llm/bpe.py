"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked symbol list.

Texts are cut where a blank run meets a word, so that every piece can be encoded by itself: the pre-tokeniser never
makes a token that spans such a cut. Pieces are kept in a bounded cache, and only new ones reach the merge loop.

Null and empty texts give no ids; any text length works (the queue makes long words cost n log n); special token
strings in a text become their ids; repeated rows are encoded alike; extra columns are left aside.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm.common import model, schema_of, slices, texts_of, tidied, tokenizer_path
from scriptorium.llm.pieces import SPACE, Pieces

#: The byte-level pre-tokeniser's pattern (fixed value).
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, others follow from U+0100."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizer JSON file."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.symbol = [vocab[s] for s in symbols]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in spec["model"]["merges"])
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for r, (a, b) in enumerate(pairs):
            self.rank[vocab[a], vocab[b]] = r
            self.merged.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pretokens = regex.compile(PRETOKEN)
        to_byte = {s: b for b, s in enumerate(symbols)}
        spelled = vocab | self.special
        self.spelling = [b""] * (max(spelled.values()) + 1)
        for s, i in spelled.items():
            self.spelling[i] = bytes(to_byte[c] for c in s) if all(c in to_byte for c in s) else s.encode()
        self.pieces = Pieces(self.encode_pieces, np.dtype("<u4"))

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token: pop the least rank (leftmost on ties), join its pair, queue the two new neighbours' pairs."""
        ids = [self.symbol[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        rank, merged = self.rank, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [r * n + i for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = divmod(heapq.heappop(queue), n)
            j = after[i]
            if j >= n or ids[i] < 0 or rank.get((ids[i], ids[j])) != r:
                continue  # stale: one of the two symbols has been merged meanwhile
            ids[i], ids[j] = merged[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := rank.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(queue, x * n + i)
            h = before[i]
            if h >= 0 and (x := rank.get((ids[h], ids[i]))) is not None:
                heapq.heappush(queue, x * n + h)
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces as little-endian 32-bit integers: special tokens first, then pre-tokens, then merges."""
        out = []
        for piece in pieces:
            ids: list[int] = []
            for part in self.split_special.split(piece) if self.split_special else [piece]:
                if part in self.special:
                    ids.append(self.special[part])
                else:
                    for word in self.pretokens.findall(part):
                        ids += self.merge(word.encode())
            out.append(np.array(ids, "<u4").tobytes())
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.pieces.ids(texts)

    def decode(self, ids: np.ndarray) -> str:
        """Concatenate the vocabulary's strings; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.spelling.__getitem__, ids.tolist())).decode("utf-8", "replace")


def load(path: str) -> Bpe:
    """One vocabulary for each Python worker."""
    return model(f"bpe {path}", lambda: Bpe(path))


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True, decoded: bool = False, digests: bool = False) -> DataFrame:
    """Encode every whole text (null: empty).

    Returns the kept columns, n_tokens, and as asked: ids (array<int>), decoded (the text from the ids), ids_sha256 and
    decoded_sha256 (of the ids as little-endian 32-bit integers and of the decoded text in UTF-8). One row for each input
    row, no shuffle.
    """
    source = docs.select(*keep, text)
    schema = schema_of(docs.select(*keep), ", ".join(["n_tokens long", *["ids array<int>"] * ids, *["decoded string"] * decoded, *["ids_sha256 string", "decoded_sha256 string"] * digests]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path(vocabulary))
        for whole in batches:
            for batch in slices(whole, text):
                coded = bpe.encode(texts_of(batch, text))
                out = {k: batch.column(i) for i, k in enumerate(keep)}  # the text comes last
                out["n_tokens"] = pa.array([len(x) for x in coded], pa.int64())
                if ids:
                    out["ids"] = pa.array([x.astype("i4") for x in coded], pa.list_(pa.int32()))
                if decoded or digests:
                    again = [bpe.decode(x) for x in coded]
                    if decoded:
                        out["decoded"] = pa.array(again, pa.string())
                    if digests:
                        out["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in coded])
                        out["decoded_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in again])
                yield pa.RecordBatch.from_pydict(out)

    return source.mapInArrow(tidied(run), schema)
