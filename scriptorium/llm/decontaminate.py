"""Benchmark decontamination: a BM25 inverted index of test items, queried with every training passage by block-max WAND.

Terms are pairs of neighbouring words (letters A-Z in lower case, ASCII punctuation as blanks). Items are indexed in chunks of at
most CHUNK pairs; a training text is cut into passages of twice as many that overlap by half, so that each place where a chunk
fits lies within a passage. A posting's impact is its BM25 score divided by the score that the chunk reaches with itself, so
that one threshold serves all chunks. Upper bounds of whole lists rule out most passages at once; the others go through
block-max WAND: each list is kept in blocks with their greatest impact and last place, whole blocks are skipped by these, and
every chunk at or above the threshold is found. A retrieved chunk is verified by its word triples, of which the text must hold
QUESTION; an item with an answer of its own also needs ANSWER of the answer's. A long item is found by any of its chunks.

The index lies in npz files of the shared folder, each built by one task from a bounded group of items. The texts are scanned once,
without a shuffle: a worker holds HELD_BYTES of texts and goes through the files one after another, with one of them in memory.

Cases: null and empty texts have no passages; null and empty items are never found; items of one word are never found (they
have no pair); equal items are all reported; an item without an id counts, and stands as null at the end of the ids; repeated rows
are judged alike; equal scores make no difference, as all chunks at the threshold are found; very long texts are read whole,
passage by passage; without items all texts are clean; an empty table gives an empty table; clashing column names of the texts
are left aside by report() and kept by keep_clean().
"""

from __future__ import annotations

import io
import math
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import bytes_of, filesystem, model, new_path, put_file, schema_of, slices, tidied, with_columns, written
from scriptorium.llm.shingles import _mix, shingle_hashes, word_hashes

CHUNK = 64
K1, B = 1.2, 0.75
THRESHOLD = 0.5
#: Shares of the chunk's and the answer's word triples that the text must hold.
QUESTION, ANSWER = 0.5, 0.5
#: Postings in a block, bytes of item text in one index file, bytes of texts that a worker takes through the files at once.
BLOCK = 64
GROUP_BYTES = 16 << 20
HELD_BYTES = 32 << 20
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
_GATE = 1 << 22


def plain(text: bytes) -> bytes:
    return text.translate(_PLAIN)


def pair_hashes(words: np.ndarray) -> np.ndarray:
    return _mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15)) + words[1:] if len(words) > 1 else np.empty(0, np.uint64)


def triples(text: bytes, size: int = 3) -> set[bytes]:
    words = plain(text).split()
    size = min(size, len(words))
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def build_index(items: DataFrame, key: str = "item_id", question: str = "text", answer: str | None = None, group_bytes: int = GROUP_BYTES) -> list[str]:
    """Write index files; returns their URIs. Document frequencies and mean length are those of all items."""
    spark, path = items.sparkSession, new_path(items.sparkSession, "bm25")
    answered = F.col(answer).cast("string") if answer else F.lit(None).cast("string")
    source = items.select(F.col(key).cast("long").alias("item"), F.coalesce(F.col(question), F.lit("")).alias("q"), answered.alias("a"))
    size = source.agg(F.coalesce(F.sum(F.length("q") + F.coalesce(F.length("a"), F.lit(0))), F.lit(0))).first()[0]
    groups = max(1, math.ceil(size / group_bytes))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, q, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = word_hashes(plain((q + (" " + a if a else "")).encode()))
                name = uuid.uuid4().hex
                said = shingle_hashes(word_hashes(plain((a or "").encode())), 3)
                for n in range(0, max(1, len(words)), CHUNK):
                    # the last pair of a chunk reaches into the next one
                    own = words[n : n + CHUNK + 1]
                    rows.append((item, f"{name}-{n}", pair_hashes(own).view(np.int64), shingle_hashes(own, 3).view(np.int64), said.view(np.int64)))
            columns = [*zip(*rows, strict=True)] or [[]] * 5
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.string(), longs, longs, longs), strict=True)], names=["item", "chunk", "terms", "own", "answer"])

    chunks = written(source.mapInArrow(tidied(split), "item long, chunk string, terms array<long>, own array<long>, answer array<long>").where("size(terms) > 0"), "chunks")
    total = chunks.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean")).first()
    if not total["n"]:
        return []
    postings = chunks.select("chunk", F.explode("terms").alias("term")).groupBy("chunk", "term").agg(F.count("*").alias("tf"))
    spread = postings.groupBy("term").agg(F.count("*").alias("df"))
    weighed = postings.join(spread, "term").groupBy("chunk").agg(F.collect_list(F.struct("term", "tf", "df")).alias("terms"))
    rows = chunks.select("item", "chunk", "own", "answer", F.size("terms").alias("n")).join(weighed, "chunk").withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int"))
    count, mean = total["n"], float(total["mean"])

    def build(table: pa.Table) -> pa.Table:
        term, place, impact = [], [], []
        for i, (n, terms) in enumerate(zip(table["n"].to_pylist(), table["terms"].to_pylist(), strict=True)):
            own = np.array([math.log(1 + (count - t["df"] + 0.5) / (t["df"] + 0.5)) * t["tf"] * (K1 + 1) / (t["tf"] + K1 * (1 - B + B * n / mean)) for t in terms])
            term += [t["term"] for t in terms]
            place += [i] * len(terms)
            impact += (own / own.sum()).tolist()
        kept = packed(np.array(term, np.int64).view(np.uint64), np.array(place, np.int32), np.array(impact), table["item"].to_pylist(), table["own"].to_pylist(), table["answer"].to_pylist())
        name = f"{path}/{uuid.uuid4().hex}.npz"
        buffer = io.BytesIO()
        np.savez(buffer, **kept)
        put_file(name, lambda out: out.write(buffer.getvalue()))
        return pa.table({"file": [name]})

    return sorted(r["file"] for r in written(rows.groupBy("group").applyInArrow(build, "file string"), "index").collect())


def packed(term: np.ndarray, place: np.ndarray, impact: np.ndarray, items: list[int | None], own: list[list[int]], answer: list[list[int]]) -> dict[str, np.ndarray]:
    """The arrays of an index file: postings by term and place, the greatest impact and the last place of each block of a list, and the triples of each chunk and answer."""
    order = np.lexsort((place, term))
    term, place, impact = term[order], place[order], impact[order]
    terms, first = np.unique(term, return_index=True)
    ends = np.append(first, len(term))
    begins = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(ends.tolist(), ends[1:].tolist())] or [np.empty(0, np.int64)])
    blocks = np.searchsorted(begins, ends)  # number of each list's first block
    lists = lambda xs: (np.array([x for one in xs for x in one], np.int64), np.cumsum([0, *map(len, xs)]))
    (own_, own_ends), (answer_, answer_ends) = lists(own), lists(answer)
    return {
        "terms": terms, "ends": ends, "place": place, "impact": impact, "blocks": blocks, "block_most": np.maximum.reduceat(impact, begins) if len(begins) else impact, "block_last": place[np.append(begins[1:], len(place)) - 1] if len(begins) else place,
        "items": np.array([0 if i is None else i for i in items], np.int64), "named": np.array([i is not None for i in items], bool), "own": own_, "own_ends": own_ends, "answer": answer_, "answer_ends": answer_ends,
    }


class Index:
    """One index file in a worker's memory."""

    def __init__(self, kept: dict[str, np.ndarray]):
        self.terms, self.ends = kept["terms"], kept["ends"].tolist()
        self.place, self.impact = kept["place"].tolist(), kept["impact"].tolist()
        self.blocks, self.block_most, self.block_last = kept["blocks"].tolist(), kept["block_most"].tolist(), kept["block_last"].tolist()
        self.most = np.maximum.reduceat(kept["impact"], kept["ends"][:-1]) if len(self.terms) else np.empty(0)
        self.items = [i if named else None for i, named in zip(kept["items"].tolist(), kept["named"].tolist(), strict=True)]
        self.gate = np.zeros(_GATE, bool)
        self.gate[(self.terms & np.uint64(_GATE - 1)).astype(np.int64)] = True
        self.sides = {side: (kept[side].view(np.uint64), kept[f"{side}_ends"]) for side in ("own", "answer")}

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of indexed terms and their numbers."""
        at = np.flatnonzero(self.gate[(hashes & np.uint64(_GATE - 1)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        good = self.terms[number] == hashes[at]
        return at[good], number[good]

    def wand(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """All chunks whose score with the distinct terms of a passage reaches the threshold, by block-max WAND."""
        place, impact, done = self.place, self.impact, len(self.items)
        lists = [[self.ends[t], self.ends[t + 1], float(self.most[t]), self.ends[t], self.blocks[t], self.blocks[t + 1]] for t in query]  # at, end, bound, begin, first and last block
        current = lambda x: place[x[0]] if x[0] < x[1] else done
        least = threshold - 1e-9
        found = []

        def seek(x: list, target: int) -> None:
            """Go to the first posting at or behind the target: whole blocks by their last places, then within one."""
            if current(x) < target:
                block = bisect_left(self.block_last, target, x[4] + (x[0] - x[3]) // BLOCK, x[5])
                begin = x[3] + (block - x[4]) * BLOCK
                x[0] = bisect_left(place, target, max(x[0], begin), min(begin + BLOCK, x[1])) if block < x[5] else x[1]

        def block_at(x: list, target: int) -> tuple[float, int]:
            """Greatest impact and last place of the block in which a target would lie; the list doesn't move."""
            block = bisect_left(self.block_last, target, x[4] + (x[0] - x[3]) // BLOCK, x[5])
            return (self.block_most[block], self.block_last[block]) if block < x[5] else (0.0, done)

        while True:
            lists = sorted((x for x in lists if x[0] < x[1]), key=current)
            bound, pivot = 0.0, -1
            for i, x in enumerate(lists):
                bound += x[2]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                return found
            target = current(lists[pivot])
            while pivot + 1 < len(lists) and current(lists[pivot + 1]) == target:
                pivot += 1
            blocks = [block_at(x, target) for x in lists[: pivot + 1]]
            if sum(b for b, _ in blocks) >= least:
                score = 0.0
                for x in lists[: pivot + 1]:
                    seek(x, target)
                    if current(x) == target:
                        score += impact[x[0]]
                        x[0] += 1
                if score >= least:
                    found.append((target, score))
            else:  # nothing up to the end of the nearest block, or to the next list, can reach the threshold
                jump = min([last + 1 for _, last in blocks] + [current(x) for x in lists[pivot + 1 : pivot + 2]])
                for x in lists[: pivot + 1]:
                    seek(x, max(jump, target + 1))

    def passages(self, hashes: np.ndarray, threshold: float) -> dict[int, float]:
        """The best score of each chunk that the passages of a text (the hashes of its pairs) retrieve."""
        found: dict[int, float] = {}
        at, number = self.known(hashes)
        if len(at):
            starts = passage_starts(len(hashes))
            total = np.concatenate([[0.0], np.cumsum(self.most[number])])
            low, high = np.searchsorted(at, starts), np.searchsorted(at, starts + 2 * CHUNK)
            for i in np.flatnonzero(total[high] - total[low] >= threshold - 1e-6):
                for chunk, score in self.wand(sorted(set(number[low[i] : high[i]].tolist())), threshold):
                    found[chunk] = max(found.get(chunk, 0.0), score)
        return found

    def verified(self, chunk: int, held: np.ndarray) -> bool:
        """Whether a text holds enough of the chunk's and of the answer's triples; held has the hashes of its runs of one to three words, sorted."""

        def share(side: str, least: float) -> bool:
            values, ends = self.sides[side]
            own = values[ends[chunk] : ends[chunk + 1]]
            at = np.minimum(np.searchsorted(held, own), len(held) - 1)
            return int((held[at] == own).sum()) >= least * len(own)

        return share("own", QUESTION) and share("answer", ANSWER)


def passage_starts(pairs: int) -> np.ndarray:
    return np.arange(0, max(1, pairs - CHUNK), CHUNK) if pairs else np.empty(0, np.int64)


def _load(uri: str) -> Index:
    def read() -> Index:
        fs, at = filesystem(uri)
        with fs.open_input_file(at) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as kept:
            return Index(dict(kept))

    return model(f"index {uri}", read)


FOUND = "__passages long, __retrieved array<long>, __items array<long>, __found long, __score double"


def _held(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[list[pa.RecordBatch]]:
    """Slices of about HELD_BYTES together."""
    held, size = [], 0
    for whole in batches:
        for batch in slices(whole, text):
            held.append(batch)
            size += batch.nbytes
            if size >= HELD_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def search(docs: DataFrame, files: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with what the index files know of each row: __passages, __retrieved and __items (distinct ids retrieved, and verified too; ascending, null last), __found (verified chunks), __score (the best)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, text):
            words = [[word_hashes(plain(raw)) for raw in bytes_of(batch, text)] for batch in held]
            rows = [[[set(), set(), 0, 0.0] for _ in own] for own in words]
            for uri in files:
                index = _load(uri)
                for own, out in zip(words, rows, strict=True):
                    for w, x in zip(own, out, strict=True):
                        found = index.passages(pair_hashes(w), threshold)
                        if found:
                            runs = np.unique(np.concatenate([shingle_hashes(w, k) for k in (1, 2, 3)]))
                            good = [c for c in found if index.verified(c, runs)]
                            x[0] |= {index.items[c] for c in found}
                            x[1] |= {index.items[c] for c in good}
                            x[2] += len(good)
                            x[3] = max(x[3], *found.values())
            ids = lambda s: sorted(i for i in s if i is not None) + [None] * (None in s)
            for batch, own, out in zip(held, words, rows, strict=True):
                longs = pa.list_(pa.int64())
                yield with_columns(batch, {"__passages": pa.array([len(passage_starts(len(w) - 1 if len(w) else 0)) for w in own], pa.int64()), "__retrieved": pa.array([ids(x[0]) for x in out], longs), "__items": pa.array([ids(x[1]) for x in out], longs), "__found": pa.array([x[2] for x in out], pa.int64()), "__score": pa.array([x[3] for x in out], pa.float64())})

    return docs.mapInArrow(tidied(run), schema_of(docs, FOUND))


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", question: str = "text", answer: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """id, n_passages, n_retrieved, score, item_ids (ascending, null last) and contaminated of each text."""
    found = search(docs.select(key, text), build_index(items, item, question, answer), text, threshold)
    return found.select(F.col(key).alias("doc_id"), F.col("__passages").alias("n_passages"), F.size("__retrieved").cast("long").alias("n_retrieved"), F.col("__score").alias("score"), F.col("__items").alias("item_ids"), (F.col("__found") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """Rows of docs that hold no test item."""
    # columns get other names, so that none clashes
    named = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    found = search(named, build_index(items, **options), f"c{docs.columns.index(text)}").where(F.col("__found") == 0)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
