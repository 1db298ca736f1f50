"""Queries that SQL can't express, over whole tables against brute force."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash

from scriptorium.llm import queries
from tests.llm.test_operators import library


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def ids(rows):
    t = library()
    return [t.encode(x, add_special_tokens=False).ids for _, x in rows]


def test_token_ids(spark, sf, rows, ids):
    want, at = collections.Counter(), 0
    for (d, _), own in zip(rows, ids, strict=True):
        own = [*own, 2]
        want[d, at, len(own), zlib.crc32(np.array(own, "<u4"))] += 1
        at += len(own)
    found = queries.op1_token_ids(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert collections.Counter(map(tuple, found)) == want


def test_bpe(spark, sf, rows, ids):
    t = library()
    want = collections.Counter((d, len(own), hashlib.sha256(np.array(own, "<u4")).hexdigest(), hashlib.sha256(t.decode(own, skip_special_tokens=False).encode()).hexdigest()) for (d, _), own in zip(rows, ids, strict=True))
    found = queries.op3_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert collections.Counter(map(tuple, found)) == want


def test_token_counts(spark, sf, rows):
    t = library()
    t.encode_special_tokens = True
    want = collections.Counter((d, len(t.encode(x, add_special_tokens=False).ids)) for d, x in rows)
    assert collections.Counter(map(tuple, queries.op8_token_counts(spark, sf).select("doc_id", "n_tokens").collect())) == want


def shard_of(key, n):
    """The greatest -1 / ln(u) of n shards of equal weight, by the 64-bit hash of key and number."""
    first = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
    u = [((xxhash.xxh64_intdigest(i.to_bytes(4, "little"), first) >> 11) + 0.5) / 2**53 for i in range(n)]
    return max(range(n), key=lambda i: (-1 / math.log(u[i]), -i))


def test_sharding(spark, sf, rows):
    found = queries.op7_sharding(spark, sf).collect()
    want = collections.Counter((d, len(x.encode()) + 1, zlib.crc32(x.encode()), "key", shard_of(d, 16), shard_of(d, 17)) for d, x in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in found) == want
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_long_texts(spark):
    """A text over the size of a slice and one very long word: words, shingles, passages and terms of the whole."""
    from scriptorium.llm import decontaminate, lexical_search, near_dups, quality, simhash, suffix_dedup

    long = " ".join(f"w{i}" for i in range(900_000))
    docs = spark.createDataFrame([(1, long), (2, "x" * 5_000_000), (3, long + " end"), (4, "short one")], "doc_id long, text string")
    assert len(long) > 4 << 20
    assert {r["doc_id"]: r["n_words"] for r in quality.report(docs.withColumn("lang", docs["text"].substr(1, 0))).select("doc_id", "n_words").collect()} == {1: 900_000, 2: 1, 3: 900_001, 4: 2}
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dups.near_duplicates(docs, words=4).collect()} == {1: (899_997, 1), 2: (1, 2), 3: (899_998, 1), 4: (1, 4)}
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    items = spark.createDataFrame([(1, "W899999"), (2, " ".join(f"w{i}" for i in range(500_000, 500_060)))], "item_id long, text string")
    assert [(r["item_id"], r["doc_id"]) for r in lexical_search.search(docs, items).where("rank = 1 and item_id = 1").collect()] == [(1, 1)]
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs, items).collect()} == {2, 4}
    removed = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.report(docs.where("doc_id != 2")).collect()}
    assert removed == {1: len(long), 3: len(long), 4: 0}
