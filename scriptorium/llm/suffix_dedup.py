"""Suffix-array dedup: find every byte that a repeated string covers, across all documents and within each.

A string counts if it has LENGTH bytes. With `words`, passages of over so many words are found as well: the same search runs over
each text's words, every one written as its 64-bit hash, so that a passage's bytes, blanks and line breaks don't matter.

A full suffix array isn't needed. In every string of the least length the GRAM-byte strings with the least hash are anchors, and
equal strings have equal anchors at equal places. So only the suffixes (to the right) and reversed prefixes (to the left) at anchors
are sorted, and only those whose neighbourhood occurs more than once:

1. each document gives its anchors: gram hash, hash of the context that strings through the anchor can reach, short hashes of
   SLOTS neighbourhoods of the gram, place;
2. anchors whose gram hash occurs once are dropped; equal contexts are one class. A class of two or more covers its whole context.
   A string that two classes share fills one of the neighbourhoods at least, so a class that shares none with another is done;
3. the contexts of a gram's other classes are sorted by deep-shallow sorting, once to the right and once to the left. Each
   interval of common prefixes to the right is a set of places that share so many bytes; within it, neighbours to the left
   give the longest common left side of each place. Where both sides together hold a string that counts, they are covered.
   A gram with more than MANY such classes is sorted in parts, one for each neighbourhood that classes share. Only a part
   that has more than MANY classes itself isn't gathered: the strings through its anchors are hashed and counted instead;
4. the covered ranges go back to all places of their classes and are united in each document.

Equal contexts are told by 64-bit hashes (xxh3), strings of very common parts by 128-bit ones; the rest is compared byte by byte.

Cases: null and empty texts have no bytes; texts under the least length are left whole; overlaps count, also with a string's own
later start; repeated rows repeat each other's strings; null ids are told apart by the text's hash; an empty table gives an empty
table; extra columns are left aside by report() and kept by remove(), whatever their names; matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import bytes_of, discard, key_of, runs, schema_of, slices, tidied, written
from scriptorium.llm.shingles import _BYTES, _POWERS, _SPACES, _mix, word_bounds, word_hashes
from scriptorium.llm.suffix_sort import common, sort_suffixes

LENGTH, GRAM = 400, 96
#: Bytes of a word's hash, and words of a gram in the search by words.
WORD_BYTES, GRAM_WORDS = 8, 12
#: Neighbourhoods of a gram, each with a hash of so many bits.
SLOTS, SLOT_BITS = 3, 20
#: Classes that one task sorts at most.
MANY = 50_000


def _slide(x: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """The best value of each run of `width` values."""
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, fill, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(blocks, width)
    ahead = best.accumulate(rows, axis=1).ravel()
    behind = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return best(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM, unit: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are least in some string of `length` bytes, and the packed hashes of their neighbourhoods.

    A neighbourhood reaches so far to the left and right that a string of `length` bytes through the gram fills one of them;
    its hash has a bit on top that says that the text holds it whole. A unit of WORD_BYTES takes grams at whole words only.
    """
    if len(text) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    raw = np.frombuffer(text, np.uint8 if unit == 1 else np.uint64)
    length, gram = length // unit, gram // unit
    up, down = _POWERS.of(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_BYTES[raw] if unit == 1 else raw) * up, dtype=np.uint64)])
    hashes = _mix((total[gram:] - total[:-gram]) * down[: len(raw) - gram + 1])
    width = length - gram + 1
    least = _slide(hashes, width, np.minimum, 0xFFFFFFFFFFFFFFFF)
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(hashes == _slide(padded, width, np.maximum, 0))
    # rounded up, so that the steps reach a gram at the end of its string too
    near, step = np.zeros(len(at), np.int64), -(-(length - gram) // SLOTS)
    for j in range(SLOTS):
        begin, end = at - step * j, at + length - step * (j + 1)
        whole = (begin >= 0) & (end <= len(raw))
        begin, end = np.maximum(begin, 0), np.minimum(end, len(raw))
        bits = _mix((total[end] - total[begin]) * down[begin]) >> np.uint64(64 - SLOT_BITS)
        near = near << (SLOT_BITS + 1) | np.where(whole, bits.astype(np.int64) | 1 << SLOT_BITS, 0)
    return at * unit, hashes[at], near


def cover(lefts: list[bytes], rights: list[bytes], length: int) -> np.ndarray:
    """For distinct contexts of one place each: how far the shared strings of `length` bytes reach to the left and right (0, 0: none)."""
    n = len(rights)
    reach = np.zeros((n, 2), np.int64)
    mirrored = [x[::-1] for x in lefts]
    longest = max(map(len, lefts), default=0)
    # intervals come from deep to shallow: a string that reaches no further to the left than an earlier one lies within it
    seen = np.full(n, -1, np.int64)
    if n == 2:
        depth = common(*rights)
        if depth + longest >= length and (best := common(*mirrored)) + depth >= length:
            reach[:] = best, depth
        return reach
    order, lcp = sort_suffixes(rights)
    by_left, left_lcp = (np.array(x, np.int64) for x in sort_suffixes(mirrored))
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    ranks = rank[order]

    def interval(depth: int, begin: int, end: int) -> None:
        if depth + longest < length:
            return
        inside = np.sort(ranks[begin:end])
        # neighbours share the least of the common prefixes between them
        shared = np.minimum.reduceat(left_lcp[: inside[-1] + 1], inside[:-1] + 1)
        best = np.maximum(np.append(shared, 0), np.append(0, shared))
        members = by_left[inside]
        good = (best > seen[members]) & (best + depth >= length)
        at = members[good]
        seen[at] = best[good]
        reach[at, 0] = best[good]
        reach[at, 1] = np.maximum(reach[at, 1], depth)

    stack: list[tuple[int, int]] = []  # open intervals: depth, begin
    for i in range(1, n + 1):
        depth, begin = (lcp[i] if i < n else -1), i - 1
        while stack and stack[-1][0] > depth:
            d, begin = stack.pop()
            interval(d, begin, i)
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, begin))
    return reach


def text_key(key: str, text: str) -> Column:
    """One number for a row's id and text; rows that have both in common share it."""
    return F.xxhash64(key_of(key), F.coalesce(F.col(text), F.lit("")))


def by_words(text: bytes) -> bytes:
    """The text's words, each as the 8 bytes of its hash."""
    return word_hashes(text).tobytes()


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text", many: int = MANY, view: Callable[[bytes], bytes] = bytes, unit: int = 1) -> DataFrame:
    """Covered ranges: k (text_key of the row) and spans (array of start, end in bytes of the view of its text, which has parts of `unit` bytes; they may overlap)."""
    import xxhash  # noqa: F401  the tasks need it too

    side = length - gram
    source = docs.select(text_key(key, text).alias("k"), F.col(text).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for batch in slices(whole, "text"):
                at, grams, nears, contexts, rows = [], [], [], [], []
                for row, t in enumerate(map(view, bytes_of(batch))):
                    p, h, near = anchors(t, length, gram, unit)
                    at.append(p)
                    grams.append(h)
                    nears.append(near)
                    contexts += [xxhash.xxh3_64_intdigest(t[max(0, i - side) : i + length], min(i, side)) for i in p.tolist()]
                    rows += [row] * len(p)
                taken = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_pydict({"gram": pa.array(np.concatenate(grams).view(np.int64)), "context": pa.array(np.array(contexts, np.uint64).view(np.int64)), "near": pa.array(np.concatenate(nears)), "k": batch.column(0).take(taken), "at": pa.array(np.concatenate(at).astype(np.int32))})

    found = written(source.mapInArrow(tidied(find), "gram long, context long, near long, k long, at int"), "anchors")
    # written, so that the join can be split where a gram is very common
    repeated = written(found.groupBy("gram").agg(F.count("*").alias("places")).where("places > 1").select("gram"), "repeated")
    places = written(found.join(repeated, "gram"), "places")
    discard(found, repeated)
    classes = written(places.groupBy("gram", "context").agg(F.count("*").alias("n"), F.first("near").alias("near"), F.min(F.struct("k", "at")).alias("one")), "classes")
    slot = [F.shiftright("near", (SLOT_BITS + 1) * (SLOTS - 1 - j)).bitwiseAND((2 << SLOT_BITS) - 1) for j in range(SLOTS)]
    parts = classes.select("gram", "context", "one", F.explode(F.array(*(F.when(s >= 1 << SLOT_BITS, s + (j << (SLOT_BITS + 1))) for j, s in enumerate(slot)))).alias("part")).where("part is not null")
    shared = written(parts.groupBy("gram", "part").agg(F.count("*").alias("classes")).where("classes > 1"), "shared")
    close = written(parts.join(shared, ["gram", "part"]).groupBy("gram", "context").agg(F.first("one").alias("one"), F.collect_list(F.struct("part", "classes")).alias("parts")), "close")
    common_grams = close.groupBy("gram").agg(F.count("*").alias("classes")).where(F.col("classes") > many).select("gram", F.lit(True).alias("hot"))
    # a gram's classes together (part -1), or those of a hot gram in each of its parts
    each = F.when(F.coalesce("hot", F.lit(False)), F.transform("parts", lambda p: F.struct(p["part"].alias("part"), (p["classes"] > many).alias("hot")))).otherwise(F.array(F.struct(F.lit(-1).alias("part"), F.lit(False).alias("hot"))))
    sought = close.join(common_grams, "gram", "left").select("one.k", F.struct("gram", "context", "one.at", each.alias("parts")).alias("x")).groupBy("k").agg(F.collect_list("x").alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for t, found in zip(map(view, bytes_of(batch)), batch.column(batch.schema.get_field_index("found")).to_pylist(), strict=True):
                    rows += [(x["gram"], x["context"], p["part"], p["hot"], t[max(0, x["at"] - side) : x["at"]], t[x["at"] : x["at"] + length]) for x in found for p in x["parts"]]
                for i in range(0, len(rows), 4096):
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows[i : i + 4096], strict=True), kinds, strict=True)], names=["gram", "context", "part", "hot", "before", "after"])

    # rows with a common key have one text
    contexts = written(source.join(sought, "k").select("text", "found").mapInArrow(tidied(cut), "gram long, context long, part long, hot boolean, before binary, after binary"), "contexts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[int] = []
        held: list[int] = []
        reaches: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            reach = np.concatenate([np.zeros((0, 2), np.int64), *reaches])
            out = pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(held, pa.int64()), *(pa.array(reach[:, i]) for i in range(2))], names=["gram", "context", *REACH])
            grams.clear(), held.clear(), reaches.clear()
            return out

        for _, table in runs(batches, "bucket"):
            one = {c: (b, a) for c, b, a in zip(*(table[x].to_pylist() for x in ("context", "before", "after")), strict=True)}
            reach = cover([b for b, _ in one.values()], [a for _, a in one.values()], length)
            some = np.flatnonzero(reach[:, 1])
            if len(some):
                named = [*one]
                grams += [table["gram"][0].as_py()] * len(some)
                held += [named[i] for i in some.tolist()]
                reaches.append(reach[some])
            if len(grams) > 10_000:
                yield flush()
        yield flush()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for g, c, b, a in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                whole, base = b + a, len(b)
                starts = np.array([o for o in range(max(0, base + gram - length), base + 1, unit) if o + length <= len(whole)], np.int64)
                if len(starts):
                    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(whole[o : o + length]) for o in starts.tolist()), "<i8").reshape(-1, 2)
                    many_of = lambda x: pa.array(np.full(len(starts), x, np.int64))
                    yield pa.RecordBatch.from_pydict({"gram": many_of(g), "context": many_of(c), "left": pa.array(base - starts), "lo": pa.array(digests[:, 0]), "hi": pa.array(digests[:, 1])})

    schema = "gram long, context long, " + ", ".join(f"{x} long" for x in REACH)
    bucketed = contexts.where("not hot").select(F.concat_ws(":", "gram", "part").alias("bucket"), "gram", "context", "before", "after")
    sorted_ = bucketed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(compare), schema)
    strings = contexts.where("hot").select("gram", "context", "before", "after").dropDuplicates(["gram", "context"]).mapInArrow(tidied(hashed), "gram long, context long, left long, lo long, hi long")
    # a string with several anchors is here once for each, so that anchor and place belong to its key
    string = ["gram", "left", "lo", "hi"]
    twice = strings.groupBy(*string).agg(F.count("*").alias("classes")).where("classes > 1")
    counted = strings.join(twice, string).groupBy("gram", "context").agg(F.max("left").alias("reach_left"), F.max(F.lit(length) - F.col("left")).alias("reach_right"))
    whole = classes.where("n > 1").select("gram", "context", F.lit(side).cast("long").alias("reach_left"), F.lit(length).cast("long").alias("reach_right"))
    reached = written(whole.unionByName(sorted_).unionByName(counted).groupBy("gram", "context").agg(*(F.max(c).alias(c) for c in REACH)), "reached")
    discard(classes, shared, close, contexts)
    span = F.struct(F.greatest(F.lit(0), F.col("at") - F.col("reach_left")).cast("int").alias("start"), (F.col("at") + F.col("reach_right")).cast("int").alias("end"))
    spans = places.join(reached, ["gram", "context"]).select("k", span.alias("span"))
    return spans.groupBy("k").agg(F.collect_set("span").alias("spans"))


REACH = ("reach_left", "reach_right")


def united(spans: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """Maximal ranges of n bytes that the spans cover."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], min(s["end"], n)) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def whole_words(raw: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges, widened so that no word is cut."""
    gaps = np.flatnonzero(_SPACES[np.frombuffer(raw, np.uint8)])
    is_gap = lambda i: raw[i] in b" \t\n\v\f\r"
    wider = []
    for a, b in ranges:
        if not is_gap(a):
            i = np.searchsorted(gaps, a)
            a = int(gaps[i - 1]) + 1 if i else 0
        if not is_gap(b - 1):
            i = np.searchsorted(gaps, b)
            b = int(gaps[i]) if i < len(gaps) else len(raw)
        wider.append({"start": a, "end": b})
    return united(wider, len(raw))


def passages(raw: bytes, spans: list[dict] | None, words: int) -> list[dict]:
    """Ranges of bytes of the words that spans over the word view cover, with the blanks between them; words that a span has only in part don't count."""
    found = []
    if spans:
        begin, end = word_bounds(raw)
        for a, b in united(spans, WORD_BYTES * len(begin)):
            first, last = -(-a // WORD_BYTES), b // WORD_BYTES
            if last - first > words:
                found.append({"start": int(begin[first]), "end": int(end[last - 1])})
    return found


def _passages(docs: DataFrame, key: str, text: str, words: int, many: int) -> DataFrame:
    """Spans over the word view of repeated runs of over `words` words, as covered() gives them."""
    gram = min(GRAM_WORDS, (words + 1) // 3 or 1)
    return covered(docs, WORD_BYTES * (words + 1), WORD_BYTES * gram, key, text, many, by_words, WORD_BYTES)


def _apply(docs: DataFrame, text: str, key: str, columns: list[str], found: list[DataFrame], step, schema: str) -> DataFrame:
    """step over the columns (named c0, c1 ..., so that no name clashes), followed by the spans of each table in `found`."""
    keyed = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), text_key(key, text).alias("k"))
    for i, spans in enumerate(found):
        keyed = keyed.join(spans.withColumnRenamed("spans", f"s{i}"), "k", "left")
    return keyed.drop("k").mapInArrow(tidied(step), schema)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int | None = None, many: int = MANY, **options) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the remaining bytes) of each document.

    With `words`, also n_passages and n_passage_bytes: maximal ranges of repeated passages of over so many words, and their bytes
    with the blanks between words. They change nothing in the other columns.
    """
    found = [covered(docs, key=key, text=text, many=many, **options)]
    if words is not None:
        found.append(_passages(docs, key, text, words, many))
    kind, tables = docs.schema[key].dataType.simpleString(), len(found)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["n_passages", "n_passage_bytes"] * (words is not None)]
    kinds = [pa.string() if x == "kept_sha256" else pa.int64() for x in names]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "c1"):
                rows = []
                for t, spans, *own in zip(bytes_of(batch, "c1"), *(batch.column(2 + i).to_pylist() for i in range(tables)), strict=True):
                    cut = united(spans, len(t))
                    kept, at = hashlib.sha256(), 0
                    for a, b in cut:
                        kept.update(t[at:a])
                        at = b
                    kept.update(t[at:])
                    repeated = [passages(t, x, words) for x in own]
                    rows.append((len(t), sum(b - a for a, b in cut), len(cut), kept.hexdigest(), *(n for x in repeated for n in (len(x), sum(r["end"] - r["start"] for r in x)))))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows, strict=True), kinds)], names=["doc_id", *names])

    return _apply(docs, text, key, [key, text], found, step, f"doc_id {kind}, " + ", ".join(f"{x} {'string' if x == 'kept_sha256' else 'long'}" for x in names))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int | None = None, many: int = MANY, **options) -> DataFrame:
    """docs with the covered bytes cut out of the text; a character that is cut in part goes whole. With `words`, repeated passages of over so many words go too, and words that are cut in part go whole. Null texts stay null."""
    columns = docs.columns
    where = columns.index(text)
    found = [covered(docs, key=key, text=text, many=many, **options)]
    if words is not None:
        found.append(_passages(docs, key, text, words, many))
    width, tables = len(columns), len(found)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, f"c{where}"):
                old, kept = batch.column(where).to_pylist(), []
                spans = [batch.column(width + i).to_pylist() for i in range(tables)]
                for t, *own in zip(old, *spans, strict=True):
                    if not any(own):
                        kept.append(t)
                        continue
                    raw, at, parts = t.encode(), 0, []
                    ranges = own[0] or []
                    if words is not None:
                        ranges = [*ranges, *passages(raw, own[1], words)]
                    ranges = united(ranges, len(raw))
                    for a, b in ranges if words is None else whole_words(raw, ranges):
                        parts.append(raw[at:a])
                        at = b
                    kept.append("".join(x.decode("utf-8", "ignore") for x in [*parts, raw[at:]]))
                arrays = batch.columns[:width]
                arrays[where] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return _apply(docs, text, key, columns, found, step, schema_of(docs, "x int").rsplit(", ", 1)[0])
