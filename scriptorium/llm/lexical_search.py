"""Ranked lexical search: the best documents of each item by a blocked sparse matrix product of integers.

One pass over the texts counts each document's terms and keeps those that some item has. From these counts come N, L and df, and
with them an int64 impact for each posting. A block of documents is then a sparse matrix of terms by documents in rows (a row for each term);
an item's row of scores is the sum of the rows of its terms, each times the term's multiplicity, merged in numpy after Gustavson
(one accumulator for the whole block). Of each block only the `top` best documents of an item go on, tasks keep a running top,
and Spark ranks what the tasks give in two steps, so that no task gathers the rows of all tasks for an item.

The vocabulary of the items goes to all tasks. Items are cut into groups of GROUP_BYTES of text at most, and each group has a pass
of its own over the texts, so that what is sent doesn't grow with the number of items.

Cases: null and empty texts, and texts without a term, count for nothing and are never found; null and empty items find nothing;
equal items (id and text) are one, items that share an id only are ranked each by itself; null item ids stay; repeated documents
are rows of their own, equal scores go by ascending doc_id with nulls last; very long texts are split in bounded pieces; an empty
table gives an empty table; extra columns are left aside, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import bytes_of, slices, tidied, written

TOP = 50
GROUP_BYTES = 16 << 20
#: Documents of one block of the product.
BLOCK = 4096
_PIECE = 4 << 20
#: Bytes outside of terms are ASCII ones that are neither digits nor letters (fixed by the contract); A-Z get lower case.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
_LAST = np.iinfo(np.int64).max


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    plain, begin = text.translate(_PLAIN), 0
    while begin < len(plain):
        end = len(plain) if len(plain) - begin <= _PIECE else plain.find(b" ", begin + _PIECE)
        end = len(plain) if end < 0 else end
        yield plain[begin:end].split()
        begin = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def grouped_items(items: DataFrame, item: str, text: str, group_bytes: int) -> Iterator[list[tuple]]:
    """Distinct (id, text) pairs, in groups of bounded size; they come one after another, not all at once."""
    held: list[tuple] = []
    size = 0
    for r in items.select(F.col(item).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct().orderBy(F.col("i").asc_nulls_last(), "t").toLocalIterator():
        if held and size + len(r["t"]) > group_bytes:
            yield held
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += len(r["t"])
    if held:
        yield held


def counted(docs: DataFrame, vocabulary: list[bytes], key: str, text: str) -> DataFrame:
    """doc, n (terms with repeats), terms (numbers in the vocabulary) and tfs of each text with a term; written."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    numbers: dict[bytes, int] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers.update((t, i) for i, t in enumerate(shared.value))
        for whole in batches:
            for batch in slices(whole, "text"):
                rows, ns, found, tfs = [], [], [], []
                for row, raw in enumerate(bytes_of(batch)):
                    n, tf = 0, Counter()
                    for piece in terms(raw):
                        n += len(piece)
                        tf.update(i for i in map(numbers.get, piece) if i is not None)
                    if n:
                        rows.append(row)
                        ns.append(n)
                        found.append(list(tf))
                        tfs.append(list(tf.values()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ns, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc", "n", "terms", "tfs"])

    source = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    return written(source.mapInArrow(tidied(run), "doc long, n long, terms array<int>, tfs array<bigint>"), "counted")


def frequencies(postings: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    found = postings.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # the items' vocabulary
    df = np.zeros(size, np.int64)
    for r in found:
        df[r["term"]] = r["df"]
    return df


class Best:
    """The best documents of each item so far: score, then ascending document."""

    def __init__(self, n: int, top: int):
        self.top = top
        self.scores, self.docs = [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        if len(self.scores[item]) >= self.top:  # what can't be among the best is left out first
            good = scores >= self.scores[item][-1]
            scores, docs = scores[good], docs[good]
        if len(scores) > 4 * self.top:
            good = scores >= np.partition(scores, -self.top)[-self.top]
            scores, docs = scores[good], docs[good]
        if len(scores):
            scores, docs = np.concatenate([self.scores[item], scores]), np.concatenate([self.docs[item], docs])
            order = np.lexsort((docs, -scores))[: self.top]
            self.scores[item], self.docs[item] = scores[order], docs[order]


def product(item_terms: list[tuple[np.ndarray, np.ndarray]], best: Best, docs: np.ndarray, at: np.ndarray, number: np.ndarray, impact: np.ndarray) -> None:
    """Multiply the items (term numbers, factors) with one block: at, number and impact hold its postings' document rows, terms and impacts."""
    order = np.argsort(number, kind="stable")
    number, at, impact = number[order], at[order], impact[order]
    present, first = np.unique(number, return_index=True)
    bounds = np.append(first, len(number)).tolist()
    rows = {t: (at[a:b], impact[a:b]) for t, a, b in zip(present.tolist(), bounds, bounds[1:], strict=False)}
    scores = np.zeros(len(docs), np.int64)
    for item, (own, factors) in enumerate(item_terms):
        scores[:] = 0
        for t, factor in zip(own.tolist(), factors.tolist(), strict=True):
            if t in rows:
                columns, values = rows[t]
                scores[columns] += factor * values  # a document is once in a row
        some = np.flatnonzero(scores > 0)
        best.add(item, scores[some], docs[some])


def ranked(rows: DataFrame, by: list[Column | str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top)


def _group(docs: DataFrame, held: list[tuple], key: str, text: str, top: int, repeats: bool) -> DataFrame:
    spark = docs.sparkSession
    own = [Counter(t for piece in terms(x.encode()) for t in piece) for _, x in held]
    vocabulary = sorted(set().union(*own))
    numbers = {t: i for i, t in enumerate(vocabulary)}
    postings = counted(docs, vocabulary, key, text)
    whole = postings.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    n_docs, length = whole["N"], whole["L"]
    weights = np.array([weight(n_docs, int(x)) for x in frequencies(postings, len(vocabulary))], np.int64)
    matrix = []
    for counts in own:
        at = np.array(sorted(numbers[t] for t in counts), np.int64)
        times = np.array([counts[vocabulary[i]] if repeats else 1 for i in at.tolist()], np.int64)
        matrix.append((at, times * weights[at]))
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = Best(len(items), top)
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(begin, BLOCK)
                ids = batch.column(0).fill_null(_LAST).to_numpy()
                n = batch.column(1).to_numpy()
                sizes = batch.column(2).value_lengths().to_numpy()
                at = np.repeat(np.arange(len(ids)), sizes)
                m = 50 + 50 * n * n_docs // length
                impact = impacts(batch.column(3).flatten().to_numpy(), m[at])
                product(items, best, ids, at, batch.column(2).flatten().to_numpy(), impact)
        sizes = [len(x) for x in best.scores]
        found = np.concatenate([np.empty(0, np.int64), *best.docs])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(items)), sizes)), pa.array(found, mask=found == _LAST), pa.array(np.concatenate([np.empty(0, np.int64), *best.scores]))], names=["item", "doc", "score"])

    best = postings.mapInArrow(tidied(run), "item long, doc long, score long")
    tasks = postings.rdd.getNumPartitions()
    # two steps: the tasks' rows of an item meet in about as many slots as each slot has tasks
    slotted = best.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(max(1, math.isqrt(tasks)))))
    last = ranked(ranked(slotted, ["item", "slot"], top).drop("rank"), ["item"], top)
    named = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(held)], "item long, item_id long")
    return last.join(named, "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP, repeats: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the `top` best documents of each item, all with a score above 0; with `repeats` a term counts as often as the item has it."""
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for n, held in enumerate(grouped_items(items, item, item_text, group_bytes)):
        found = _group(docs, held, key, text, top, repeats)
        out = found if not n else out.unionByName(found)
    return out
