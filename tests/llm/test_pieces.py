"""Both encoders against the library on texts that are cut in different ways."""

import numpy as np
from tokenizers import Tokenizer

from scriptorium.llm.bpe import Bpe
from scriptorium.llm.common import tokenizer_path
from scriptorium.llm.encoding import LibraryEncoder
from scriptorium.llm.pieces import Pieces

TEXTS = ["", "one two", " lead", "  two  blanks ", "nul\0 x\0", " ", "\n", "a.\nb c", "don't 's\n\nx", "é.\nÉ y", "x" * 300 + " y", "one two", "end<|endoftext|> on"]


def test_encoders():
    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    for encoder in (LibraryEncoder("byte_bpe_50k.json"), Bpe(path)):
        for _ in range(2):  # the second time from the store
            assert [x.tolist() for x in encoder.encode(TEXTS)] == want
        assert [x.tolist() for x in encoder.encode([""])] == [[]] and encoder.encode([]) == []


def test_small_store():
    pieces = Pieces(lambda ps: [np.array([len(p)] * 2, "<u2").tobytes() for p in ps], np.dtype("<u2"), kept=4)
    for text in ("a bb ccc", "bb dddd eeeee", "a bb ccc"):
        got = pieces.ids([text])[0].tolist()
        words = [len(w) + (i > 0) for i, w in enumerate(text.split(" "))]
        assert got == [n for n in words for _ in range(2)]
    assert len(pieces.young) <= 4 + 4
