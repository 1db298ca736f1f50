"""Ranked search, SimHash and vector codes against brute force, on awkward rows and small tables."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from scriptorium.llm import lexical_search, simhash, vector_codes
from tests.llm.test_operators import SCHEMA, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def brute_search(docs, items, top=50, repeats=False):
    counts = [(d, collections.Counter(TERM.findall(low(t)))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, length = len(counts), sum(n for *_, n in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    out = collections.Counter()
    for item, text in set(items):
        own = collections.Counter(TERM.findall(low(text)))
        scores = []
        for d, c, n in counts:
            m = 100 - 50 + (50 * n * n_docs) // length
            score = sum((times if repeats else 1) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, times in own.items() if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out.update((item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:top], 1))
    return out


@pytest.mark.parametrize("options", [{}, {"top": 2, "group_bytes": 20}, {"repeats": True}])
def test_search(spark, docs, options):
    items = [(1, "one two two W1 w2"), (2, "é中 x"), (2, "w3"), (3, None), (4, ""), (None, "w5 w6 w7"), (5, "w3"), (5, "w3"), (6, "absent ..."), (7, "ENDOFTEXT y")]
    got = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), **options)
    options = {k: v for k, v in options.items() if k != "group_bytes"}
    assert collections.Counter(map(tuple, got.collect())) == brute_search([(r[0], r[1]) for r in rows()], items, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


def test_search_in_pieces(monkeypatch):
    text = "".join(random.Random(1).choice("ab ,é") for _ in range(5000)).encode()
    whole = [t for piece in lexical_search.terms(text) for t in piece]
    monkeypatch.setattr(lexical_search, "_PIECE", 7)
    assert [t for piece in lexical_search.terms(text) for t in piece] == whole == [t.encode() for t in TERM.findall(text.decode())]


def brute_fingerprint(text):
    words = WORD.findall(low(text))
    size = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, bits):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    x = np.array(prints, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= bits):
            root[find(i)] = find(int(j))
    least = collections.defaultdict(list)
    for i, d in enumerate(ids):
        least[find(i)] += [d] * (d is not None)
    return [min(least[find(i)], default=None) for i in range(len(ids))]


def test_simhash(docs, table):
    for df in (docs, table):
        own = [(r["doc_id"], r["text"]) for r in df.collect()]
        prints = [brute_fingerprint(t) for _, t in own]
        want = collections.Counter(zip([d for d, _ in own], [f"{x:016x}" for x in prints], brute_components([d for d, _ in own], prints, 4), strict=True))
        assert collections.Counter(map(tuple, simhash.near_duplicates(df).collect())) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_fingerprint_in_pieces(monkeypatch):
    text = " ".join(random.Random(2).choice(["a", "b", "cc", "é"]) for _ in range(500))
    monkeypatch.setattr(simhash, "_PIECE", 9)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("bits,block", [(4, 256), (4, 7), (2, 5), (0, 5), (6, 16)])
def test_simhash_links(spark, bits, block):
    """Chains and clouds of fingerprints, small blocks: the components of all pairs."""
    rng = random.Random(bits * 100 + block)
    prints = {0, 2**64 - 1}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(40):  # a chain whose ends are far apart
            prints.add(at)
            for _ in range(rng.randrange(1, max(2, bits + 2))):
                at ^= 1 << rng.randrange(64)
        cloud = rng.getrandbits(64)
        for _ in range(40):
            x = cloud
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(22)
            prints.add(x)
    prints = sorted(prints)
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "print long"), bits, block).collect()
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        assert ((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= bits
        root[find(r["a"])] = find(r["b"])
    groups = collections.defaultdict(set)
    for x in signed:
        groups[find(x)].add(x)
    want = collections.defaultdict(set)
    for x, c in zip(signed, brute_components(signed, prints, bits), strict=True):
        want[c].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_nearest_with_ties():
    rng = np.random.default_rng(7)
    for points, queries in (((256, 16), 900), ((40, 2), 500), ((1, 3), 5), ((60, 1), 80)):
        book = rng.integers(-3, 4, points)  # many equal entries and distances
        asked = rng.integers(-4, 5, (queries, points[1]))
        apart = ((asked[:, None] - book[None]) ** 2).sum(axis=2)
        index, distance = vector_codes.nearest(vector_codes.kd_tree(book, leaf=3), book, asked)
        assert (index == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()


def brute_codes(vectors, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([v for _, v, _ in kept], np.int64).reshape(len(kept), 4, -1)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = x[order].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        apart = ((x[:, :, None] - books[None]) ** 2).sum(axis=3)
        best = apart.argmin(axis=2)
        if r < rounds:
            for p in range(4):
                for e in set(best[:, p].tolist()):
                    own = x[best[:, p] == e, p]
                    books[p, e] = own.sum(axis=0) // len(own)
    errors = apart.min(axis=2).sum(axis=1).tolist()
    labels = collections.Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] += e
    return collections.Counter((i, "".join(f"{c:02x}" for c in best[k].tolist()), errors[k], labels[label]) for k, (i, _, label) in enumerate(kept))


def test_vector_codes(spark):
    rng = random.Random(9)
    schema = "vec_id long, embedding array<float>, label int, q string, id int"
    vectors = [(k if k % 50 else None, [rng.randrange(-3, 4) / 16 for _ in range(8)], [None, 1, 2][k % 3]) for k in range(400)]
    vectors += [(7, vectors[8][1], 1), (7, vectors[7][1], 1), (900, None, 1), (901, [1.0] * 7 + [None], 2), (902, [float("nan")] + [0.0] * 7, 2), (903, [float("-inf")] * 8, None)]
    df = spark.createDataFrame([(*v, "x", 1) for v in vectors], schema)
    for entries in (256, 16, 1000):
        got = vector_codes.report(df, entries=entries)
        want = brute_codes(vectors, entries)
        assert collections.Counter((r["vec_id"], r["code"] if entries < 1000 else "".join(f"{int(r['code'][i : i + 3], 16):02x}" for i in range(0, 12, 3)), r["error"], r["label_error"]) for r in got.collect()) == want
        assert len({r["codebooks_sha256"] for r in got.collect()}) == 1
    assert vector_codes.report(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1), (3, [1e30] * 8, 1), (4, [], 1)], "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: (r["code"], r["error"]) for r in vector_codes.report(odd).collect()} == {1: ("00000000", 0), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_reconstruct(spark, sf):
    coded, books = vector_codes.compress(spark.read.parquet(f"{sf}/embeddings.parquet"))
    given = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    for r in coded.collect():
        x = np.floor(1024 * np.array(given[r["id"]], np.float64)).astype(np.int64)
        assert ((vector_codes.reconstruct(r["code"], books) - x) ** 2).sum() == r["error"]
