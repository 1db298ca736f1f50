"""The ten operators against brute force, on awkward rows and on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import bpe, components, decontaminate, licences, near_dups, quality, sharding, suffix_dedup, suffix_sort, token_counts, token_store, warc
from scriptorium.llm.common import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, row string, tie string, gram int, k int, kept string, `__text` string"


def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(150)]
    near = base[:60] + ["changed"] + base[61:]
    far = base[:75] + [rng.choice(words) for _ in range(75)]
    texts = [None, "", "   ", "one", "Two Words", " ".join(base), " ".join(base), " ".join(near), " ".join(far), "é中\U0001f600 <|endoftext|> x", "a" * 900, "x y " * 2000, " ".join(base).upper()]
    return [(i if i % 4 else None, t, ["en", None][i % 2], "s", 1, 1, "r", "t", 1, 1, "k", "z") for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", 1, 1, "r", "t", 1, 1, "k", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_store(spark, docs):
    store = token_store.write(docs, new_path(spark, "t"), shard_bytes=2000, part_keys=4)
    token_store.save_manifest(store)
    store = token_store.open_store(store.path)
    assert len(store.files) > 1 and store.n_parts > 1
    found = token_store.read(store, token_store.lookup(store, store.entries(spark).select("key", "copy")), digests=True).collect()
    t = library()
    order = sorted(((r[0] if r[0] is not None else -(2**63), r[1] or "") for r in rows()), key=lambda r: r[0])
    want = collections.Counter((k, zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4"))) for k, x in order)
    assert collections.Counter((r["key"], r["ids_crc32"]) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["key"] for r in sorted(found, key=lambda r: r["start"])] == [k for k, _ in order]
    missing = spark.createDataFrame([(10**6 + i, 0) for i in range(500)], "key long, copy long")
    assert token_store.lookup(store, missing).count() == 0
    assert token_store.lookup(token_store.write(docs.limit(0), new_path(spark, "t")), missing).count() == 0


def test_perfect_hash():
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    assert sorted(token_store.PerfectHash.build(np.unique(h)).slots(np.unique(h))) == list(range(len(np.unique(h))))


def test_warc(spark, sf):
    pages = spark.createDataFrame([(3, "u", "a"), (1, "u", "a"), (None, "u", "a"), (4, None, None), (5, "u", ""), (6, "x\ny", "é" * 5000)], "page_id long, url string, html string")
    path = new_path(spark, "w")
    files = warc.write(pages, path, archive_bytes=1000)
    found = sorted(warc.read(spark, path, files).collect(), key=lambda r: (r["page_id"] is None, r["page_id"]))
    assert [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["faults"]) for r in found] == [(1, "response", None, 1, []), (3, "revisit", 1, 1, []), (4, "response", None, 0, []), (5, "revisit", 4, 0, []), (6, "response", None, 10000, []), (None, "revisit", 1, 1, [])]
    assert found[4]["payload"].decode() == "é" * 5000 and found[0]["payload_digest"] == warc.digest_of(b"a")
    assert warc.write(pages.limit(0), new_path(spark, "w")) == []
    real = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r["page_id"]: r["html"] or "" for r in real.collect()}
    path = new_path(spark, "w")
    got = warc.read(spark, path, warc.write(real, path)).collect()
    assert len(got) == len(want) and all(not r["faults"] for r in got)
    assert all(r["payload"].decode() == want[r["page_id"]] for r in got if r["record_type"] == "response")


def test_damaged_archive():
    raw = warc.page_record(1, "u", b"abc", None, "x")
    assert warc.parse_record(raw)["faults"] == []
    assert "block length" in warc.parse_record(raw[:-5])["faults"]
    assert "payload digest" in warc.parse_record(raw.replace(b"abc", b"abd"))["faults"]
    assert "version line" in warc.parse_record(raw.replace(b"WARC/1.1", b"WRAC/1.1"))["faults"]


def test_bpe(docs, table):
    t = library()
    for df in (docs, table.limit(60)):
        want = collections.Counter()
        for r in df.collect():
            ids = t.encode(r["text"] or "", add_special_tokens=False).ids
            want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4")).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
        assert collections.Counter(tuple(r) for r in bpe.encode(df, ids=False, digests=True).collect()) == want
    assert bpe.encode(docs.limit(0)).count() == 0


def test_licences_in_long_lines(table):
    """Each template, alone or two of them, in a line of 200 ordinary words, and no other family."""
    classifier = licences.train(table)
    rng = random.Random(3)
    ordinary = " ".join(r["text"] for r in table.where("lang = 'en' and not text rlike '(?i)licen'").orderBy("doc_id").collect()).split()
    planted = [(family, t) for family, ts in licences.TEMPLATES.items() for t in ts]
    for n, (family, t) in enumerate(planted):
        begin = rng.randrange(len(ordinary) - 200)
        words = ordinary[begin : begin + 200]
        other, u = planted[(n + 7) % len(planted)]
        cases = [(words[:k] + [t] + words[k:], {family}) for k in (0, 67, 200)] + [(words[:60] + [t] + words[60:150] + [u] + words[150:], {family, other})]
        for parts, want in cases:
            assert {x[1] for x in classifier.scan(" ".join(parts).encode()) if x[3] >= licences.SHARE} == want, t
    assert not [x for x in classifier.scan(" ".join(ordinary[:5000]).encode()) if x[3] >= licences.SHARE]


def test_licences(spark, docs, table):
    classifier = licences.train(table)
    assert classifier.accuracy > 0.95
    cases = [(1, "x\nReleased under the MIT License.\ny"), (2, "Licensed under CC BY-NC 4.0."), (3, "The pilot lost his license."), (4, None), (5, "This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0.")]
    found = {r["doc_id"]: r["families"] for r in licences.scan(spark.createDataFrame(cases, "doc_id long, text string"), classifier=classifier).collect()}
    assert found == {1: ["MIT"], 2: ["CC-BY-NC"], 3: [], 4: [], 5: ["Apache-2.0", "GPL"]}
    assert licences.scan(docs, classifier=classifier).count() == docs.count()
    short = {"All rights reserved.": ["Proprietary"], "Copyright 2020 Foo. All rights reserved.": ["Proprietary"], "MIT License": ["MIT"], "SPDX-License-Identifier: Apache-2.0": ["Apache-2.0"], "SPDX-License-Identifier: MIT": ["MIT"], "# SPDX-License-Identifier: BSD-3-Clause": ["BSD"], "The License": [], "for the": []}
    found = {r["doc_id"]: r["families"] for r in licences.scan(spark.createDataFrame(list(enumerate(short)), "doc_id long, text string"), classifier=classifier).collect()}
    assert [found[i] for i in range(len(short))] == [*short.values()]


def test_licences_prune_nothing(table):
    """The bound changes no verdict: every window scored gives the same notices, on ordinary texts and on texts with notices."""
    import copy

    classifier = licences.train(table)
    whole = copy.copy(classifier)
    whole.start = 1e9
    some = [r["text"].encode() for r in table.orderBy("doc_id").collect() if len(r["text"]) < 6000][:120]
    some += [t[:200] + b" " + n.encode() + b"\n" + t[200:900] for t, n in zip(some, [t for ts in licences.TEMPLATES.values() for t in ts])]
    assert [classifier.scan(t) for t in some] == [whole.scan(t) for t in some]


def test_licences_held_out(table):
    """Whole templates that training hasn't seen, one of each family that has three or more."""
    held = {ts[1]: f for f, ts in licences.TEMPLATES.items() if len(ts) > 2}
    assert licences.Classifier(licences.sample_lines(table), without=tuple(held)).held_out(held) >= 0.6
    assert licences.sample_lines(table) == licences.sample_lines(table.repartition(7))


def brute_near(data, n, percent=80):
    sets, low = [], str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for _, t in data:
        w = WORD.findall((t or "").translate(low))
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return collections.Counter((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(data, sets)))


@pytest.mark.parametrize("block", [2, 256])
def test_near_dups(spark, docs, table, block):
    for df, n in ((docs, 4), (table, 5), (docs.limit(0), 5)):
        data = [(r["doc_id"], r["text"]) for r in df.collect()]
        found = near_dups.near_duplicates(df, words=n, block=block).select("id", "n_shingles", "component_id").collect()
        assert collections.Counter(tuple(r) for r in found) == brute_near(data, n)


def test_near_dups_chain(spark):
    """A chain of which neighbours are similar and ends are not: no bucket's least member is near all."""
    rng = random.Random(2)
    words = [f"c{i}" for i in range(400)]
    texts = [" ".join(words[i * 4 : i * 4 + 200]) for i in range(20)]
    data = [(int(i), t) for i, t in zip(rng.sample(range(100), 20), texts)]
    found = near_dups.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), words=4, block=3).select("id", "n_shingles", "component_id").collect()
    assert collections.Counter(tuple(r) for r in found) == brute_near(data, 4)


def test_one_of_each(docs):
    kept = near_dups.one_of_each(docs, words=4)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert sum((t or "").split() == [] for t in texts) == 3 and sum((t or "").lower().startswith("w") for t in texts) == 2


def test_one_of_each_clash(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 77, 5, 9, 3, 8), (2, "g h", 88, 6, 9, 3, 8)], "doc_id long, text string, _k long, k long, t long, one long, c0 long")
    assert sorted(tuple(r) for r in near_dups.one_of_each(df).collect()) == sorted(tuple(r) for r in df.collect())


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 100), (7, 60), (200, 201)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert {found[i] for i in [*range(51), 60]} == {0} and found[201] == 200 and 100 not in found


def masks(texts, length, words=None):
    """The bytes that repeated strings cover, and those that they and repeated passages of over `words` words do."""
    seen, passages = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1)), collections.Counter()
    split = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] if words is not None else [] for t in texts]
    run = lambda t, at, i: tuple(t[a:b] for a, b in at[i : i + words + 1])
    for t, at in zip(texts, split):
        passages.update(run(t, at, i) for i in range(len(at) - (words or 0)))
    for t, at in zip(texts, split):
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = True
        wide = mask.copy()
        inside = [False] * len(at)
        for i in range(len(at) - words if words is not None else 0):
            if passages[run(t, at, i)] > 1:
                inside[i : i + words + 1] = [True] * (words + 1)
        for i, (a, b) in enumerate(at):  # blanks between two such words go with them
            if inside[i]:
                wide[a : at[i + 1][0] if inside[i + 1 : i + 2] == [True] else b] = True
        yield t, mask, wide


def brute_spans(texts, length):
    out = []
    for t, mask, _ in masks(texts, length):
        edges = np.diff(np.concatenate([[0], mask.astype(int)]))
        out.append((len(t), int(mask.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~mask].tobytes()).hexdigest()))
    return out


def brute_removed(texts, length, words):
    """The texts without repeated strings and passages, and without the words that these cut."""
    out = []
    for t, _, wide in masks(texts, length, words):
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", t):
            if wide[m.start() : m.end()].any():
                wide[m.start() : m.end()] = True
        out.append(np.frombuffer(t, np.uint8)[~wide].tobytes().decode("utf-8", "ignore"))
    return out


@pytest.mark.parametrize("many", [1, 50_000])
def test_suffix_dedup(spark, docs, table, many):
    for df in (docs, table, docs.limit(0)):
        data = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
        want = collections.Counter((d, *x) for (d, _), x in zip(data, brute_spans([t for _, t in data], 400)))
        assert collections.Counter(tuple(r) for r in suffix_dedup.report(df, many=many).collect()) == want


@pytest.mark.parametrize("many", [1, 50_000])
def test_passages(spark, docs, table, many):
    """Passages of over 50 words against brute force, those of very short words (under 240 bytes) and with other blanks and line breaks too."""
    data = [(r["doc_id"], r["text"] or "") for r in table.unionByName(docs.select(table.columns[0:2]), allowMissingColumns=True).collect()]
    rng = random.Random(4)
    long = [rng.choices(w, k=n) for n, w in ((51, ["ab", "cde", "fghij", "klm"]), (55, ["a", "b", "c"]), (70, ["at", "to", "of", "in"]), (50, ["ab", "cde", "x"]))]
    data += [(10**6 + i, " ".join(rng.choices(["x1", "yy2", "zzz3", "w\n"], k=40)) + rng.choice([" ", "\n"]) + rng.choice([" ", "\n", "  "]).join(long[i % 4]) + rng.choice([" ", "\n"]) + " ".join(rng.choices(["x1", "yy2", "zzz3"], k=30))) for i in range(24)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute_removed([t.encode() for _, t in data], 400, 50)
    assert all(len(x) < len(t) for i, ((_, t), x) in enumerate(zip(data[-24:], want[-24:])) if i % 4 < 3)
    removed = suffix_dedup.remove(df, words=50, many=many).collect()
    assert collections.Counter(tuple(r) for r in removed) == collections.Counter((d, t) for (d, _), t in zip(data, want))


@pytest.mark.parametrize("many", [1, 2, 50_000])
def test_suffix_dedup_random(spark, many):
    rng = random.Random(8)
    pool = ["".join(rng.choices("ab ", k=30)) for _ in range(6)]
    data = [(i, "".join(rng.choices(pool, k=rng.randint(1, 12)))) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS k", "2 AS spans", "3 AS __k", "4 AS c0", "5 AS s0")
    texts = [t.encode() for _, t in data]
    want = collections.Counter((d, *x) for (d, _), x in zip(data, brute_spans(texts, 50)))
    assert collections.Counter(tuple(r) for r in suffix_dedup.report(df, length=50, gram=12, many=many).collect()) == want
    removed = suffix_dedup.remove(df, length=50, gram=12, words=9, many=many)
    assert removed.columns == df.columns
    assert sorted(tuple(r) for r in removed.collect()) == sorted((d, t, 1, 2, 3, 4, 5) for (d, _), t in zip(data, brute_removed(texts, 50, 9)))


def test_suffix_sort():
    rng = random.Random(1)
    for _ in range(300):
        base = bytes(rng.choices(b"ab", k=300))
        items = [bytes(rng.choices(b"ab\0", k=rng.choice([0, 1, 9, 200]))) for _ in range(rng.randint(0, 9))] + [base[: rng.randint(50, 300)] for _ in range(rng.randint(0, 6))]
        order, lcp = suffix_sort.sort_suffixes(items)
        assert [items[i] for i in order] == sorted(items) and sorted(order) == list(range(len(items)))


def test_sharding(docs):
    for df in (docs, docs.limit(0)):
        found = sharding.report(df, [1.0] * 16).collect()
        assert len(found) == df.count() and all(r["grown_shard"] in (r["shard"], 16) for r in found)
        slots = collections.defaultdict(list)
        for r in found:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = collections.defaultdict(set)
    for r in sharding.report(docs, [1.0] * 16).collect():
        by_id[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_id.values())


def test_weights(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"))
    n = {r["shard"]: r["count"] for r in sharding.assign(df, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert 2.8 < n[1] / n[0] < 3.2


def test_token_counts(spark, docs):
    path = new_path(spark, "f")
    order = token_counts.write_flat(docs, path, file_bytes=1500)
    files = [r["file"] for r in order.select("file").distinct().collect()]
    found = token_counts.scan(spark, path, files, block_ids=64)
    t = library()
    t.encode_special_tokens = True
    want = collections.Counter((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())
    assert collections.Counter(tuple(r) for r in order.join(found, ["file", "nth"]).select("doc_id", "n_tokens").collect()) == want


def test_unfinished_document(spark, tmp_path):
    np.array([5, 6, 50256, 50256, 7, 8, 9], "<u2").tofile(tmp_path / "x.bin")
    found = sorted(tuple(r)[1:] for r in token_counts.scan(spark, f"file://{tmp_path}", ["x.bin"], block_ids=2).collect())
    assert found == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 3, False)]


def test_quality(docs, table):
    for df in (docs, table, docs.limit(0)):
        want = collections.Counter()
        for r in df.collect():
            t = r["text"] or ""
            w = WORD.findall(t)
            grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            mark = [False] * len(w)
            for i in range(len(w) - 4):
                if grams[tuple(w[i : i + 5])] > 1:
                    mark[i : i + 5] = [True] * 5
            seen, dup = set(), 0
            for line in t.split("\n"):
                dup += line in seen and bool(WORD.search(line))
                seen.add(line)
            want[r["doc_id"], len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, sum(mark), len(w) < 10 or 100 * sum(mark) > 20 * len(w)] += 1
        found = quality.report(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
        assert collections.Counter(tuple(r)[:-1] for r in found) == want
        assert not any(r["kept"] and r["base_failed"] for r in found)
        assert quality.keep_good(df).columns == df.columns


def brute_quality(rows):
    """Measures and verdicts of (text, lang) by encoding each text whole."""
    import math

    import sentencepiece

    from scriptorium.llm.common import tokenizer_path

    multi = token_counts.plain_encoder(quality.VOCABULARY)
    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(quality.PIECES))
    out = []
    for t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice, mark = {g for g, n in collections.Counter(grams).items() if n > 1}, set()
        for i, g in enumerate(grams):
            mark |= {*range(i, i + 5)} if g in twice else set()
        failed = len(w) < 10 or 100 * len(mark) > 20 * len(w)
        ids, spm = multi.encode_ordinary(t), pieces.encode(t)
        counts = collections.Counter(ids)
        entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values())
        fell = (sum(map(pieces.is_byte, spm)) - t.count("\n") - t.count("\t")) / max(1, len(spm))
        letters = [c for c in t if ord(c) >= 0x41 and c not in "×÷"]
        names = [[n for first, n in quality.SCRIPTS if ord(c) >= first][-1] for c in letters]
        spans = collections.Counter([max(first for first, _ in quality.SCRIPTS if ord(c) >= first) for c in letters])
        script = "latin" if t.isascii() and t else dict(quality.SCRIPTS)[min(spans, key=lambda x: (-spans[x], x))] if names else "other"
        tag = (re.match("[A-Za-z]+", lang or "") or [""])[0].lower()
        group = tag if tag in quality.LANGUAGES else script
        step = min(max(int(math.log2(max(len(ids), 1))) - 2, 1), len(quality.BELOW)) - 1
        chars, share, most = quality.BANDS[group]
        below = quality.BELOW[step] if group in (*quality.LANGUAGES, "latin") else 0.0
        inside = bool(ids) and sum(map(len, w)) / len(ids) >= chars - below and entropy >= share * quality.ENTROPY[step] and fell <= most
        out.append((round(fell, 9), len(ids), not failed and inside))
    return out


def test_quality_verdicts(spark, table):
    rng = random.Random(2)
    odd = ["naïve 中文 text \t with\nlines " * 20, "".join(chr(rng.randrange(0x1200, 0x1380)) + " " for _ in range(300)), " ".join("\U00010330\U00010331" for _ in range(40)), "plain words again and more of them so that there are enough of these " * 3, "\x00\x01 " * 30, "Вчера вечером мы долго гуляли по набережной и говорили о том, как изменился город за последние десять лет."]
    rows = [(r["text"], r["lang"]) for r in table.collect()] + [(t, x) for t in odd for x in ("en", None, "zz")]
    found = quality.report(spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")).collect()
    got = {r["doc_id"]: (round(r["fallback_share"], 9), r["n_tokens"], r["kept"]) for r in found}
    assert [got[i] for i in range(len(rows))] == brute_quality(rows)
    assert len({x[0] for x in got.values()}) > 3


def test_parts_at_blanks():
    import sentencepiece

    from scriptorium.llm.common import tokenizer_path

    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(quality.PIECES))
    rng = random.Random(4)
    for size in (1, 5, 40):
        t = "".join(rng.choice(["a", "word", " ", " ", "  ", "\n", "é", "\U00010330"]) for _ in range(500))
        assert sum((pieces.encode(x) for x in quality.parts_at_blanks(t, size)), []) == pieces.encode(t)


def test_quality_bands(spark):
    """Symbols after each word are rejected in nine of ten texts or more (sparse cells have no band), and plain texts stay."""
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = big.where("not text rlike '[*&%$#|]{3}| [|] |!!'").select("doc_id", "text", "lang")
    junk = plain.where("length(text) > 900 and lang = 'en'").orderBy("doc_id").limit(20).select((F.col("doc_id") + 10**6).alias("doc_id"), F.regexp_replace("text", " ", "*** ").alias("text"), "lang")
    found = quality.report(plain.unionByName(junk)).where("not base_failed")
    assert found.where("doc_id >= 1000000 and kept").count() <= 2
    assert found.where("doc_id < 1000000 and not kept").count() <= 0.01 * found.count()


def test_quality_much_junk(spark):
    """Junk is rejected and plain texts stay where a third and where two thirds of a language are junk."""
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = big.where("lang = 'en' and length(text) > 900 and not text rlike '[*&%$#|]{3}| [|] |!!'").select("doc_id", "text", "lang").cache()
    for every in (2, 1):
        junk = plain.where(f"doc_id % {every} = 0").select((F.col("doc_id") + 10**6).alias("doc_id"), F.regexp_replace("text", " ", "*** ").alias("text"), "lang")
        if every == 1:
            junk = junk.unionByName(junk.withColumn("doc_id", F.col("doc_id") + 10**6))
        found = quality.report(plain.unionByName(junk)).where("not base_failed")
        counts = {r[0]: r[1:] for r in found.groupBy(F.expr("doc_id >= 1000000")).agg(F.count("*"), F.sum(F.expr("int(kept)"))).collect()}
        assert counts[True][0] > 0.4 * counts[False][0] and counts[True][1] <= 0.02 * counts[True][0] and counts[False][1] >= 0.99 * counts[False][0]


def test_quality_alone(spark):
    """Every text has a verdict of its own: a single text, a long one and one of a rare language are judged as they are among others."""
    plain = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 9 = 0 and not text rlike '[*&%$#|]{3}| [|] |!!'").select("doc_id", "text", "lang")
    good = plain.where("lang = 'en' and length(text) > 2000").orderBy("doc_id").limit(6).collect()
    whole = " ".join(r["text"] for r in good)
    russian = "Вчера вечером мы долго гуляли по набережной и говорили о том, как изменился город за последние десять лет. Новые дома закрыли вид на реку, но старый парк остался почти таким же."
    noise = " ".join(chr(0x1F300 + random.Random(i).randrange(200)) * (1 + i % 5) for i in range(300))
    cases = [(whole, x, True) for x in ("en", "EN-us", "sw", None)] + [(whole.replace(" ", "*** "), x, False) for x in ("en", "EN-us", "sw", None)]
    cases += [(russian, "ru", True), (russian, None, True), (noise, "xx", False), (noise, None, False)]
    added = spark.createDataFrame([(-i - 1, t, x) for i, (t, x, _) in enumerate(cases)], "doc_id long, text string, lang string")
    want = {-i - 1: k for i, (_, _, k) in enumerate(cases)}
    for docs in (added, added.unionByName(plain)):
        assert {r["doc_id"]: r["kept"] for r in quality.report(docs).where("doc_id < 0").collect()} == want
    assert quality.report(added.where("doc_id = -6")).first()["kept"] is False
    assert quality.report(plain).where("kept is null").count() == 0


def test_decontaminate(spark, docs, sf):
    items = spark.createDataFrame([(1, "What is the long river of the north country called? It is the silver stream of stones."), (2, None), (3, ""), (4, " ".join(f"q{i}" for i in range(200))), (None, "a b c d e f g h")], "item_id long, text string")
    long_item = " ".join(f"q{i}" for i in range(200))
    cases = [(1, "pre " * 90 + "what is the long river of the north country called it is the silver stream of stones" + " post" * 90), (2, "The silver stream is a long river."), (3, None), (4, "x " * 70 + long_item), (5, ""), (None, "y")]
    df = spark.createDataFrame(cases, "doc_id long, text string")
    for size in (1, 1 << 20):
        found = {r["doc_id"]: r["item_ids"] for r in decontaminate.search(df, decontaminate.build_index(items, group_bytes=size * 50)).select("doc_id", F.col("__items").alias("item_ids")).collect()}
        assert found == {1: [1], 2: [], 3: [], 4: [4], 5: [], None: []}
    assert decontaminate.report(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.keep_clean(docs, items).columns == docs.columns
    odd = df.selectExpr("doc_id", "text", "1 AS __items", "2 AS c0", "3 AS __score")
    assert sorted((r[0] or 0, r[2], r[3], r[4]) for r in decontaminate.keep_clean(odd, items).collect()) == [(k, 1, 2, 3) for k in (0, 2, 3, 5)]
    assert decontaminate.report(df.limit(0), items).count() == decontaminate.keep_clean(df.limit(0), items).count() == 0


def test_empty_tables(spark):
    """Operators without another test of empty tables give empty ones."""
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licences.scan(empty).count() == 0
    path = new_path(spark, "f")
    order = token_counts.write_flat(empty, path)
    assert order.count() == 0 and token_counts.scan(spark, path, []).count() == 0


def random_index(rng, n=300):
    pairs = sorted({(int(t), int(p)) for t, p in zip(rng.zipf(1.3, 6000) % 200, rng.integers(0, n, 6000))})
    impact = rng.random(len(pairs)) * 0.1
    return decontaminate.Index(decontaminate.packed(np.array([t for t, _ in pairs], np.uint64), np.array([p for _, p in pairs], np.int32), impact, list(range(n)), [[]] * n, [[]] * n))


@pytest.mark.parametrize("block", [1, 4, 64])
def test_wand_is_exact(monkeypatch, block):
    """Block-max WAND finds what scoring every chunk finds."""
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = np.random.default_rng(3)
    n = 300
    index = random_index(rng, n)
    for _ in range(40):
        query = sorted(rng.choice(len(index.terms), 25, replace=False).tolist())
        score = np.zeros(n)
        for t in query:
            for i in range(index.ends[t], index.ends[t + 1]):
                score[index.place[i]] += index.impact[i]
        want = {i: round(float(s), 6) for i, s in enumerate(score) if s >= 0.3}
        assert {i: round(s, 6) for i, s in index.wand(query, 0.3)} == want


def brute_items(texts, items):
    """Every chunk scored against every passage, then verified; by strings."""
    import math

    split = lambda t: decontaminate.plain((t or "").encode()).split()
    chunks = [(i, w[n : n + 65]) for i, t in items for w in [split(t)] for n in range(0, max(1, len(w)), 64) if len(w[n : n + 65]) > 1]
    pairs = [collections.Counter(zip(w, w[1:])) for _, w in chunks]
    df = collections.Counter(p for c in pairs for p in c)
    mean = sum(sum(c.values()) for c in pairs) / len(pairs)
    impacts = []
    for c in pairs:
        own = {p: math.log(1 + (len(pairs) - df[p] + 0.5) / (df[p] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for p, tf in c.items()}
        impacts.append({p: x / sum(own.values()) for p, x in own.items()})
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = []
    for t in texts:
        w = split(t)
        held, seen = runs(w, 1) | runs(w, 2) | runs(w, 3), list(zip(w, w[1:]))
        found, best = set(), 0.0
        for start in range(0, max(1, len(seen) - 64), 64):
            passage = set(seen[start : start + 128])
            for (i, own), impact in zip(chunks, impacts):
                score = sum(x for p, x in impact.items() if p in passage)
                if score >= 0.5 - 1e-9:
                    best = max(best, score)
                    triples = runs(own, min(3, len(own)))
                    if len(triples & held) >= 0.5 * len(triples):
                        found.add(i)
        out.append((sorted(i for i in found if i is not None) + [None] * (None in found), round(best, 6)))
    return out


def test_decontaminate_query(spark, table, sf):
    """The query on a whole table against brute force: whole items, parts of them, items without an id, items cut at a sentence."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rng = random.Random(6)
    long = [" ".join(f"v{rng.randrange(900)}" for _ in range(200)) for _ in range(3)]
    items += [(1000, long[0]), (None, long[1]), (1001, long[2]), (1001, "short item here"), (1002, None), (1003, "word")]
    texts = [r["text"] for r in table.collect()]
    texts += [" ".join(long[0].split()[:64]), "pre " * 70 + long[1], " ".join(long[2].split()[100:170]) + " end" * 50, "a short item here b", None, ""]
    texts += [re.split(r"(?<=[.?!])\s+", t)[0] for _, t in items[:30] if t] + [" ".join(t.split()[::2]) for _, t in items[:9] if t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: (r["item_ids"], round(r["score"], 6), r["contaminated"]) for r in decontaminate.report(docs, benchmark).collect()}
    want = brute_items(texts, items)
    assert found == {n: (ids, score, bool(ids)) for n, (ids, score) in enumerate(want)}
    base = len(texts) - 6 - sum(bool(t) for _, t in items[:30]) - sum(bool(t) for _, t in items[:9])
    assert [found[base + i][0] for i in range(6)] == [[1000], [None], [1001], [1001], [], []]
    assert decontaminate.keep_clean(docs, benchmark).count() == sum(not ids for ids, _ in want)
