"""Ids of whole texts by the tokenizers library, with a bounded store of pieces in each Python worker."""

from __future__ import annotations

import os

import numpy as np

from scriptorium.llm.common import model, tokenizer_path
from scriptorium.llm.pieces import Pieces


class LibraryEncoder:
    """The library's ids (add_special_tokens=False) of a byte-level vocabulary, as raw little-endian integers.

    New pieces go to the library joined to one text: each begins with one blank and a word, where a pre-token must begin, so
    the ids are those of the pieces. The bytes that each id spells tell where a piece ends.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from scriptorium.llm.bpe import Bpe

        self.tokenizer = Tokenizer.from_file(tokenizer_path(vocabulary))
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # only new pieces reach the library, which would never find them again
        self.spelled = np.array([len(x) for x in Bpe(tokenizer_path(vocabulary)).spelling], np.int64)
        self.dtype = np.dtype("<u2" if len(self.spelled) <= 1 << 16 else "<u4")
        self.pieces = Pieces(self._encode, self.dtype)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        width = self.dtype.itemsize
        joined = [p for p in pieces if p[0] == " " and len(p) > 1 and not p[1].isspace()]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(joined)], add_special_tokens=False)[0].ids, self.dtype)
        sizes = np.fromiter(map(len, map(str.encode, joined)), np.int64, len(joined))
        ends = ((np.searchsorted(np.cumsum(self.spelled[ids]), np.cumsum(sizes)) + 1) * width).tolist()
        raw = ids.tobytes()
        coded = [raw[a:b] for a, b in zip([0, *ends], ends)]
        if len(joined) == len(pieces):
            return coded
        out = dict(zip(joined, coded, strict=True))
        alone = [p for p in pieces if p not in out]
        for p, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            out[p] = np.array(e.ids, self.dtype).tobytes()
        return [out[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.pieces.ids(texts)


def library_encoder(vocabulary: str) -> LibraryEncoder:
    """One encoder for each Python worker."""
    return model(f"library {vocabulary}", lambda: LibraryEncoder(vocabulary))
