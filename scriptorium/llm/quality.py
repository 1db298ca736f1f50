"""Quality rules by tokeniser fertility: public vocabularies tell how natural a text is in its language.

Measured on every whole text: characters per token of a multilingual vocabulary, the share of tokens that a piece vocabulary with
byte fallback spends on single bytes, and the entropy of the token distribution. All three depend on the language and,
for short texts, on the length; so there is a limit for each language (for each script, where the language isn't listed) and each
doubling of the token count. Too few characters per token or too low an entropy reject a text, and so does too great a share of
byte fallback.

The limits are fixed values, so that no share of junk moves them and no other text changes a text's verdict. Those of listed
languages are median - WIDTH standard deviations, as the interquartile range estimates them, over the rows of sf0.1 that are
labelled good and pass the base rules (3,330); shorter texts than 16 tokens are extrapolated. Other scripts have no labelled rows:
their limits are half of what a plain sentence or two gave. These are guesses, set so that only strong junk is rejected there; fit
them anew (BANDS) where texts of such scripts matter.

Base rules (fixed): fewer than 10 words, or over 20 % of the words in 5-word windows that occur twice, reject a text.

Cases: null and empty texts have no words and fail the base rules; null and unlisted languages go by script; repeated rows are judged alike;
an empty table gives an empty table; measure() keeps asked columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import model, schema_of, slices, texts_of, tidied, tokenizer_path, with_columns
from scriptorium.llm.shingles import WORD, _mix, word_hashes

VOCABULARY, PIECES = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
WIDTH = 4.5
#: Median characters per token, the share of the entropy limit that is asked for, and the greatest share of byte fallback, by language or script.
BANDS = {
    "de": (2.28, 1.0, 0.045), "en": (2.21, 1.0, 0.045), "es": (2.05, 1.0, 0.045), "fr": (2.02, 1.0, 0.045), "latin": (1.9, 1.0, 0.15),
    "cyrillic": (1.39, 0.75, 0.15), "greek": (0.74, 0.75, 0.15), "hebrew": (0.74, 0.75, 0.15), "arabic": (0.85, 0.75, 0.15), "indic": (0.38, 0.75, 0.3),
    "kana": (0.52, 0.75, 0.6), "han": (0.43, 0.75, 0.6), "hangul": (0.67, 0.75, 0.6), "other": (0.64, 0.75, 0.6),
}
LANGUAGES = ("de", "en", "es", "fr")
#: From texts of under 16 tokens on, for each doubling up to 2048 and more: how far characters per token may lie below the median, and the least entropy in bits.
BELOW = (0.89, 0.89, 0.89, 0.42, 0.3, 0.24, 0.15, 0.11, 0.09)
ENTROPY = (2.8, 3.68, 4.4, 4.56, 5.42, 5.78, 6.06, 6.25, 6.29)
SYMBOLS = b"[#*$%&|<>]"
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, fallback_share double, entropy double, script string"
#: First code points of writing systems, in order, and their names (fixed values of Unicode).
SCRIPTS = ((0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "indic"), (0xE00, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"))


#: White space that the piece vocabulary spends bytes on.
BYTE_BLANKS = "\t\n"
_PART = 1 << 20


def parts_at_blanks(text: str, size: int = _PART) -> Iterator[str]:
    """A text cut at single blanks, which go, into parts of about `size` characters: as each part's first word gets its blank back, they have the pieces of the whole."""
    begin = 0
    while len(text) - begin > size:
        at = text.find(" ", begin + size)
        while at > 0 and (text[at - 1].isspace() or text[at + 1 : at + 2].isspace()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[begin:at]
        begin = at + 1
    yield text[begin:]


def repeated_words(hashes: np.ndarray, window: int = 5) -> int:
    """Words that lie in a window of `window` words that occurs twice or more, the first time included."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    h = hashes[:n].copy()
    for k in range(1, window):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15)) + hashes[k : n + k]
    order = np.argsort(h, kind="stable")
    equal = h[order[1:]] == h[order[:-1]]
    if not equal.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + window] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word, equal to an earlier line), n_repeat_words."""
    if not raw:
        return 0, 0, 0, 0, 0
    hashes = word_hashes(raw)
    joined = raw.translate(None, b"\x20\x09\x0a\x0b\x0c\x0d")
    characters = len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80)) if not joined.isascii() else len(joined)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS[1:-1]))
    lines = raw.split(b"\n")
    seen, dup = set(), 0
    for line in lines:
        if line in seen:
            dup += bool(WORD.search(line))
        else:
            seen.add(line)
    return len(hashes), characters, symbols, dup, repeated_words(hashes)


class Fertility:
    """Token measures of texts; one for each Python worker."""

    def __init__(self) -> None:
        import sentencepiece

        from scriptorium.llm.token_counts import plain_encoder

        self.encoder = plain_encoder(VOCABULARY)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.known = {x for i in range(len(self.is_byte)) if len(x := self.pieces.id_to_piece(i)) == 1} | {" ", *BYTE_BLANKS}
        self.firsts = np.array([c for c, _ in SCRIPTS])

    def script(self, text: str) -> str:
        """The writing system of most letters."""
        if text.isascii():
            return "latin"
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        points = points[(points >= 0x41) & (points != 0xD7) & (points != 0xF7)]
        if not len(points):
            return "other"
        counts = np.bincount(np.searchsorted(self.firsts, points, side="right") - 1, minlength=len(SCRIPTS))
        return SCRIPTS[int(counts.argmax())][1]

    def fallback_share(self, text: str) -> float:
        """Share of the piece vocabulary's tokens that are single bytes, those of white space aside. A text of known characters only has none and isn't encoded."""
        if not set(text) - self.known:
            return 0.0
        total = fell = 0
        for part in parts_at_blanks(text):
            ids = np.array(self.pieces.encode(part), np.int64)
            total += len(ids)
            fell += int(self.is_byte[ids].sum()) - sum(map(part.count, BYTE_BLANKS))
        return fell / max(1, total)

    def of(self, text: str, word_chars: int) -> tuple[int, float, float, float, str]:
        if not text:
            return 0, 0.0, 0.0, 0.0, "other"
        ids = np.array(self.encoder.encode_ordinary(text), np.int64)
        counts = np.bincount(ids)
        share = counts[counts > 0] / len(ids)
        return len(ids), word_chars / len(ids), self.fallback_share(text), float(-(share * np.log2(share)).sum()), self.script(text)


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns (all, if None) of every row, then METRICS and base_failed. Names of METRICS among the kept columns are left aside."""
    names = {x.split()[0] for x in METRICS.split(", ")} | {"base_failed"}
    columns = [c for c in (docs.columns if keep is None else keep) if c not in names]
    # a kept text isn't sent twice
    held = text if text in columns else "__text"
    source = docs.select(*columns) if held == text else docs.select(*columns, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = model("fertility", Fertility)
        for whole in batches:
            for batch in slices(whole, held):
                rows = []
                for t in texts_of(batch, held):
                    base = base_counts(t.encode())
                    rows.append((*base, *fertility.of(t, base[1])))
                kinds = [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.string()]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield with_columns(batch.select(columns), dict(zip([x.split()[0] for x in METRICS.split(", ")], arrays, strict=True)))

    measured = source.mapInArrow(tidied(run), schema_of(source.select(*columns), METRICS) if columns else METRICS)
    return measured.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def judge(measured: DataFrame, lang: str | None = "lang") -> DataFrame:
    """measured with kept: false if base_failed, else whether all measures lie within the limits of the text's language (or script) and length."""
    # en-GB and EN are en
    tag = F.lower(F.regexp_extract(F.col(lang).cast("string"), "^[A-Za-z]+", 0)) if lang else F.lit(None)
    group = F.when(tag.isin(*LANGUAGES), tag).otherwise(F.col("script"))
    doubling = F.least(F.greatest(F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int") - 2, F.lit(1)), F.lit(len(BELOW)))
    by_length = lambda values: F.element_at(F.array(*map(F.lit, values)), doubling)
    by_group = lambda i: F.create_map(*(F.lit(x) for g, v in BANDS.items() for x in (g, v[i])))[group]
    # other scripts' medians are limits already
    below = F.when(group.isin(*LANGUAGES, "latin"), by_length(BELOW)).otherwise(0.0)
    inside = (F.col("chars_per_token") >= by_group(0) - below) & (F.col("entropy") >= by_group(1) * by_length(ENTROPY)) & (F.col("fallback_share") <= by_group(2))
    return measured.withColumn("kept", ~F.col("base_failed") & inside)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Base counts, measures and verdict of each document."""
    return judge(measure(docs, text, (key, lang)), lang)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of docs that the rules keep, with their own columns."""
    renamed = docs.select(*(F.col(c).alias(f"c_{i}") for i, c in enumerate(docs.columns)))
    at = {c: f"c_{i}" for i, c in enumerate(docs.columns)}
    judged = judge(measure(renamed, at[text]), at.get(lang))
    return judged.where("kept").select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)))
