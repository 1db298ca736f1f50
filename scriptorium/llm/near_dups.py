"""MinHash near-duplicates with sequential Bayesian verification.

Rows with equal shingle sets form a class. Classes that agree on a band of their MinHash signature are candidates; a candidate
pair is compared by batches of signature positions and dropped as soon as the posterior probability that its similarity
reaches the threshold falls under `miss`; what survives is confirmed on the full shingle sets.

No bucket is expanded into its pairs. First, every member of a bucket is only paired with the bucket's least class, and the links
found give components. Buckets that still hold more than one component go on: they are dealt out as pairs of blocks of bounded
size, and within such a pair of blocks only members of different components are compared, so that a dense group costs about
its size in links: the members outside the component of the bucket's least class meet its blocks and each other. Links found there join the components in a last pass. A pair at the threshold shares no band with
probability (1 - threshold**ROWS)**BANDS, 5.4e-6 at 0.8.

Cases: null and empty texts and texts without words have no shingles and are linked with nothing; texts with fewer words than a
shingle are one shingle; rows that share an id are rows of their own; null ids never are the least of a component unless all
its ids are null; an empty table gives an empty table; extra columns are left aside.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import bytes_of, slices, tidied, written
from scriptorium.llm.components import components
from scriptorium.llm.shingles import _mix, lowered, shingle_hashes, word_hashes

BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
#: Signature positions compared at once, and the posterior probability under which a candidate is dropped.
BATCH, MISS = 24, 1e-6
#: Members of one block of a bucket.
BLOCK = 256
_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_CHUNK = 1024


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a non-empty set of shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), _CHUNK):
        h = x[None, i : i + _CHUNK] ^ _XOR[:, None]
        h *= _ODD[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number takes part."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
    for k in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return h.view(np.int64)


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each number of compared batches, the least number of equal positions with which a candidate goes on.

    With a uniform prior, the posterior of the agreement rate after m of n equal positions is Beta(m + 1, n - m + 1); its upper
    tail at p is the probability of at most m successes in n + 1 trials. Positions keep 8 bits, so unequal ones agree by
    chance once in 256 times.
    """
    p = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(one: np.ndarray, others: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `others` that stay candidates of `one` through all batches, and their equal positions."""
    alive, equal = np.arange(len(others)), np.zeros(len(others), np.int64)
    for k, need in enumerate(least):
        at = slice(k * BATCH, (k + 1) * BATCH)
        equal[alive] += (others[alive, at] == one[at]).sum(axis=1)
        alive = alive[equal[alive] >= need]
        if not len(alive):
            break
    return alive, equal[alive]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection size >= percent * union size, on full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def shingles_of(text: bytes, words: int) -> np.ndarray:
    return shingle_hashes(word_hashes(lowered(text)), words)


def measure(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """row (a number of its own), id, tie (a hash of the text), n_shingles, a digest of the set (lo, hi), signature and band keys. Written, so that the numbers stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [shingles_of(t, words) for t in bytes_of(batch)]
                digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                full = [i for i, s in enumerate(sets) if len(s)]
                signatures = np.array([signature(sets[i]) for i in full], np.uint32).reshape(len(full), HASHES)
                bands, short = band_keys(signatures), (signatures & 255).astype(np.uint8)
                kept: list = [None] * len(sets)
                keys: list = [None] * len(sets)
                for j, i in enumerate(full):
                    kept[i], keys[i] = short[j].tobytes(), bands[j]
                yield pa.RecordBatch.from_pydict({"row": batch.column(0), "id": batch.column(1), "tie": batch.column(2), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "lo": pa.array(halves[:, 0]), "hi": pa.array(halves[:, 1]), "signature": pa.array(kept, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64()))})

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), tie(text).alias("tie"), F.col(text).alias("text"))
    return written(source.mapInArrow(tidied(run), "row long, id long, tie long, n_shingles long, lo long, hi long, signature binary, bands array<long>"), "measured")


def tie(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def links(classes: DataFrame, docs: DataFrame, words: int, percent: int, key: str, text: str, block: int = BLOCK) -> DataFrame:
    """Confirmed links (a, b) between classes: enough of them to connect all that are connected."""
    least = least_matches(percent / 100)
    keyed = classes.select("node", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("print")).where("n > 1")
    # buckets with the same members, from other bands, are one
    once = shared.groupBy("print", "n").agg(F.min_by(F.struct("band", "first"), "band").alias("x")).select("x.*")
    members = written(keyed.join(once, "band"), "members")
    wanted = members.select("node").distinct().join(classes.select("node", "id", "tie", "signature"), "node")
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("k"), tie(text).alias("tie"), F.col(text).alias("text"))
    candidates = written(wanted.withColumn("k", F.coalesce("id", F.lit(-(2**63)))).join(texts, ["k", "tie"]).groupBy("node").agg(F.first("signature").alias("signature"), F.first("text").alias("text")), "candidates")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
            good = [i for i in range(batch.num_rows) if len(survivors(x[i], y[i : i + 1], least)[0])]
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for whole in batches:
            for batch in slices(whole, "u"):
                a, xs, ys = batch.column(0).to_pylist(), bytes_of(batch, "t"), bytes_of(batch, "u")
                good = []
                for i, node in enumerate(a):
                    if last[0] != node:
                        last = node, shingles_of(xs[i], words)
                    if similar(last[1], shingles_of(ys[i], words), percent):
                        good.append(i)
                yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    signed, texted = candidates.select("node", "signature"), candidates.select("node", "text")
    pairs = members.where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    compared = pairs.join(signed.toDF("a", "x"), "a").join(signed.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(tidied(compare), "a long, b long")
    first = written(compared.join(texted.toDF("b", "u"), "b").join(texted.toDF("a", "t"), "a").select("a", "b", "t", "u").mapInArrow(tidied(confirm), "a long, b long"), "links")

    labels = components(first)
    labelled = members.select("band", "node", "first").join(labels, "node", "left").select("band", "node", "first", F.coalesce("component", "node").alias("component"))
    main = labelled.where("node = first").select("band", F.col("component").alias("main"))
    sided = labelled.drop("first").join(main, "band").select("band", "node", "component", (F.col("component") != F.col("main")).alias("aside"))
    sided = written(sided, "sided")
    # written, so that the joins with it can be split where a bucket is large
    open_ = written(sided.groupBy("band").agg(F.count_if("aside").alias("a"), F.count_if(~F.col("aside")).alias("m")).where("a > 0").select("band", F.ceil(F.col("a") / block).cast("int").alias("a"), F.ceil(F.col("m") / block).cast("int").alias("m")), "open")
    placed = sided.join(open_, "band").withColumn("block", F.pmod(F.xxhash64("node", "band"), F.when(F.col("aside"), F.col("a")).otherwise(F.col("m"))).cast("int"))
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # members of other components meet each block of the main one, and each other; the main component doesn't meet itself
    outer = placed.where("aside").select("band", F.lit(0).alias("kind"), F.col("block").alias("i"), F.explode(count("m")).alias("j"), "node", "component", F.lit(0).alias("part"))
    inner = placed.where("not aside").select("band", F.lit(0).alias("kind"), F.explode(count("a")).alias("i"), F.col("block").alias("j"), "node", "component", F.lit(1).alias("part"))
    apart = placed.where("aside").withColumn("other", F.explode(count("a"))).select("band", F.lit(1).alias("kind"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "component", F.col("block").alias("part"))
    dealt = outer.unionByName(inner).unionByName(apart)

    def within(table: pa.Table) -> pa.Table:
        nodes, start, blocks = (table[c].to_pylist() for c in ("node", "component", "part"))
        signs = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(-1, HASHES)
        texts, sets = table["text"], {}
        root = {c: c for c in start}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        def full(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingles_of((texts[i].as_py() or "").encode(), words)
            return sets[i]

        one = table["kind"][0].as_py() == 1 and table["i"][0].as_py() == table["j"][0].as_py()
        at = np.array([find(c) for c in start])
        found = []
        for i in range(len(nodes) - 1):
            others = i + 1 + np.flatnonzero(at[i + 1 :] != at[i])
            if not one:
                others = others[[blocks[k] != blocks[i] for k in others]]
            alive, equal = survivors(signs[i], signs[others], least)
            for k in others[alive[np.argsort(-equal, kind="stable")]]:
                if find(start[i]) != find(start[k]) and similar(full(i), full(k), percent):
                    found.append((nodes[i], nodes[k]))
                    root[find(start[k])] = find(start[i])
            if found:
                at = np.array([find(c) for c in start])
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    second = dealt.join(candidates, "node").groupBy("band", "kind", "i", "j").applyInArrow(within, "a long, b long")
    return first.unionByName(written(second, "links"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each document: id, tie (xxhash64 of its text), n_shingles, component_id (least id reachable), component (number of the group), best (the text hash of the least row of the component's least id)."""
    measured = measure(docs, words, key, text)
    full = measured.where("n_shingles > 0")
    classes = written(full.groupBy("lo", "hi").agg(F.min("row").alias("node"), F.min_by(F.struct("id", "tie", "signature", "bands"), "row").alias("x"), F.min(F.struct(F.col("id").isNull(), "id", "tie")).alias("least")).select("lo", "hi", "node", "x.*", "least"), "classes")
    labels = components(links(classes, docs, words, percent, key, text, block))
    placed = classes.select("lo", "hi", "node", "least").join(labels, "node", "left").select("lo", "hi", F.coalesce("component", "node").alias("component"), "least")
    whole = placed.groupBy("component").agg(F.min("least").alias("least"))
    group = placed.select("lo", "hi", "component").join(whole, "component")
    out = measured.select("id", "tie", "n_shingles", "row", "lo", "hi").join(group, ["lo", "hi"], "left")
    return out.select("id", "tie", "n_shingles", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("component_id"), F.coalesce("component", "row").alias("component"), F.when(F.col("component").isNull(), F.col("tie")).otherwise(F.col("least.tie")).alias("best"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the near-duplicates of others: of each group the row with the least id (null last), then the least text hash, stays."""
    found = near_duplicates(docs, words, percent, key, text)
    gone = found.where(~(F.col("id").eqNullSafe(F.col("component_id")) & (F.col("tie") == F.col("best")))).select(F.coalesce("id", F.lit(-(2**63))).alias("k"), F.col("tie").alias("t")).distinct()
    empty = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]", "")) == ""
    # columns get other names, so that none clashes
    named = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("k"), tie(text).alias("t"), F.when(empty, F.monotonically_increasing_id()).otherwise(F.lit(-1)).alias("one"))
    return named.join(gone, ["k", "t"], "left_anti").dropDuplicates(["k", "t", "one"]).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
