"""Vector code compression: product quantisation of integer vectors with exact ties.

Components become floor(scale * x). A vector is cut into equal consecutive parts, each with a codebook of its own, which starts as
that part of the vectors with the smallest ids. A round assigns each part to its nearest entry (squared Euclidean distance, ties
to the lower index) and replaces each entry by the componentwise floor of its parts' mean; unused entries stay.

In each round the driver builds a kd-tree of each codebook and broadcasts it: entries * length integers, whatever the number of
rows. Tasks search whole batches by branch and bound: at a node the nearer child is searched first, and the other one for those
rows whose bound doesn't exceed their best distance. Nodes with an equal bound are visited too, so that a lower index at the
same distance wins. A task gives one row of sums for each entry and position it used, and Spark adds them up.

Cases: rows whose vector is null or holds null or non-finite components are dropped. Vectors of another length than the one with
the smallest id, or of a length that parts doesn't divide, and those with a component beyond 2**28 after scaling (their
distances wouldn't fit a long), stay with null code and error and take no part in codebooks. Null ids come last in the order;
rows with equal ids are rows of their own, ordered by their components. Fewer rows than entries give fewer entries. Null labels
are one label. Empty vectors have distance 0. An empty table gives an empty table; other columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import tidied, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LEAF = 16
#: Greatest component after scaling.
LIMIT = 1 << 28
#: Rows that a task searches at once.
_ROWS = 16_384


@dataclass
class Node:
    """A box around its entries; a leaf has their indexes, an inner node two children and where it is split."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None = None
    axis: int = 0
    at: int = 0
    left: Node | None = None
    right: Node | None = None


def kd_tree(points: np.ndarray, indexes: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Split along the widest side at the median, until few entries or one point are left."""
    indexes = np.arange(len(points)) if indexes is None else indexes
    own = points[indexes]
    node = Node(own.min(axis=0), own.max(axis=0))
    sides = node.high - node.low
    if len(indexes) <= leaf or not len(sides) or not sides.max():
        node.entries = np.sort(indexes)
        return node
    node.axis = int(sides.argmax())
    values = np.sort(own[:, node.axis])
    node.at = int(values[(len(values) - 1) // 2])
    if node.at == values[-1]:  # all above the median are equal to it
        node.at = int(values[values < node.at][-1])
    below = own[:, node.axis] <= node.at
    node.left, node.right = kd_tree(points, indexes[below], leaf), kd_tree(points, indexes[~below], leaf)
    return node


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of all queries to a few points; exact integers, by doubles where these hold all sums."""
    reach = max(int(np.abs(queries).max(initial=0)), int(np.abs(points).max(initial=0)))
    if queries.shape[1] * reach * reach < 1 << 51:
        x, y = queries.astype(np.float64), points.astype(np.float64)
        whole = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)
        return whole.astype(np.int64)
    apart = queries[:, None] - points[None]
    return np.einsum("ijk,ijk->ij", apart, apart)


def nearest(tree: Node, points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest point of each query, the lowest among equals, and the squared distance; exact integers."""
    found = np.full(len(queries), len(points), np.int64)
    best = np.full(len(queries), np.iinfo(np.int64).max, np.int64)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        own = queries[rows]
        apart = np.maximum(np.maximum(node.low - own, own - node.high), 0)
        near = np.einsum("ij,ij->i", apart, apart) <= best[rows]  # equal bounds too
        rows, own = rows[near], own[near]
        if not len(rows):
            return
        if node.entries is not None:
            distance = distances(own, points[node.entries])
            least = distance.argmin(axis=1)  # the first, and so the lowest index, of equals
            distance, index = distance[np.arange(len(rows)), least], node.entries[least]
            closer = (distance < best[rows]) | ((distance == best[rows]) & (index < found[rows]))
            best[rows[closer]], found[rows[closer]] = distance[closer], index[closer]
            return
        left = own[:, node.axis] <= node.at
        visit(node.left, rows[left])
        visit(node.right, rows[~left])
        visit(node.right, rows[left])
        visit(node.left, rows[~left])

    visit(tree, np.arange(len(queries)))
    return found, best


def codebook_text(codebooks: np.ndarray) -> str:
    """All components as decimal integers, by part, entry and position."""
    return ",".join(map(str, codebooks.ravel().tolist()))


def integers(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """id, label, q (array of int, null where too large) of the rows that are kept; written."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.where(F.col(vector).isNotNull() & finite)
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    small = F.forall("q", lambda x: F.abs(x) <= LIMIT)
    named = kept.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), scaled.alias("q"))
    return written(named.select("id", "label", F.when(small, F.transform("q", lambda x: x.cast("int"))).alias("q")), "integers")


def _blocks(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """About _ROWS rows at once: the rows, those of them that have a code, their parts."""

    def cut(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        some = rows.column(rows.schema.get_field_index("q"))
        sizes = some.value_lengths().fill_null(-1).to_numpy()
        good = np.flatnonzero(sizes == parts * width)
        flat = some.take(pa.array(good, pa.int64())).flatten().to_numpy(zero_copy_only=False)
        return rows, good, flat.astype(np.int64).reshape(len(good), parts, width)

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= _ROWS:
            yield cut(held)
            held, n = [], 0
    if held:
        yield cut(held)


def sums(table: DataFrame, codebooks: np.ndarray) -> dict[int, int]:
    """(part * entries + entry) * (width + 1) + position: sum of the components; at position `width` the number of parts."""
    parts, entries, width = codebooks.shape
    shared = table.sparkSession.sparkContext.broadcast((codebooks, [kd_tree(c) for c in codebooks]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = shared.value
        total = np.zeros((parts, entries, width + 1), np.int64)
        for _, _, cut in _blocks(batches, parts, width):
            for p in range(parts):
                entry, _ = nearest(trees[p], books[p], cut[:, p])
                order = np.argsort(entry, kind="stable")
                used, first = np.unique(entry[order], return_index=True)
                if len(used):
                    ones = np.ones((len(order), 1), np.int64)
                    total[p, used] += np.add.reduceat(np.hstack([cut[order, p], ones]), first, axis=0)
        slots = np.flatnonzero(np.repeat(total[:, :, width] > 0, width + 1))
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slots, pa.int64()), "total": pa.array(total.ravel()[slots])})

    added = table.select("q").mapInArrow(tidied(run), "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total"))
    found = {r["slot"]: r["total"] for r in added.collect()}  # a row for each integer of the codebooks
    shared.unpersist()
    return found


def updated(codebooks: np.ndarray, found: dict[int, int]) -> np.ndarray:
    """Each used entry as the floor of its mean."""
    parts, entries, width = codebooks.shape
    total = np.zeros(parts * entries * (width + 1), np.int64)
    total[list(found)] = list(found.values())
    total = total.reshape(parts, entries, width + 1)
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), codebooks)


def train(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, position) of a table of integers(); None if no row can be coded."""
    coded = table.where("q is not null")
    head = [r["q"] for r in coded.orderBy(F.col("id").asc_nulls_last(), "q").select("q").limit(entries).collect()]
    if not head or len(head[0]) % parts:
        return None
    length = len(head[0])
    if any(len(q) != length for q in head):  # the first ones of the common length
        head = [r["q"] for r in coded.where(F.size("q") == length).orderBy(F.col("id").asc_nulls_last(), "q").select("q").limit(entries).collect()]
    codebooks = np.array(head, np.int64).reshape(len(head), parts, length // parts).transpose(1, 0, 2)
    if length:
        for _ in range(rounds):
            codebooks = updated(codebooks, sums(table, codebooks))
    return codebooks


def assign(table: DataFrame, codebooks: np.ndarray | None) -> DataFrame:
    """id, label, code (hexadecimal indexes in part order, two digits each up to 256 entries), error (squared distances summed over the parts)."""
    if codebooks is None:
        return table.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    parts, entries, width = codebooks.shape
    digits = max(2, len(f"{entries - 1:x}"))
    shared = table.sparkSession.sparkContext.broadcast((codebooks, [kd_tree(c) for c in codebooks]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = shared.value
        for batch, good, cut in _blocks(batches, parts, width):
            codes: list[str | None] = [None] * batch.num_rows
            errors: list[int | None] = [None] * batch.num_rows
            found = [nearest(trees[p], books[p], cut[:, p]) for p in range(parts)]
            error = sum(d for _, d in found).tolist()
            for row, code, e in zip(good.tolist(), np.stack([i for i, _ in found], axis=1).tolist(), error, strict=True):
                codes[row] = "".join(f"{i:0{digits}x}" for i in code)
                errors[row] = e
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    return table.select("id", "label", "q").mapInArrow(tidied(run), f"id long, label {table.schema['label'].dataType.simpleString()}, code string, error long")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """The coded rows (written) and the codebooks."""
    table = integers(vectors, key, vector, label, scale)
    codebooks = train(table, parts, entries, rounds)
    return written(assign(table, codebooks), "codes"), codebooks


def report(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """vec_id, code, error, label_error (the errors of equal labels summed, nulls together) and codebooks_sha256."""
    coded, codebooks = compress(vectors, key, vector, label, **options)
    digest = hashlib.sha256(codebook_text(codebooks).encode()).hexdigest() if codebooks is not None else None
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    # a hot label is split by the adaptive join; few labels are broadcast by their measured size
    summed = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return summed.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))


def reconstruct(code: str, codebooks: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    digits = max(2, len(f"{codebooks.shape[1] - 1:x}"))
    return np.concatenate([codebooks[p, int(code[p * digits : (p + 1) * digits], 16)] for p in range(len(codebooks))])
