"""Faults that round 3 found, each in a case of its own."""

import itertools
import random

from pyspark.sql import functions as F

from scriptorium.functions import dates, invoice, jsonops, text
from scriptorium.llm import simhash, suffix_dedup
from scriptorium.operators import datasets
from scriptorium.plans import answers, scores
from scriptorium.plans.fixtures import PERSONS, derive
from scriptorium.plans.queries import table


def test_prioritized_orders_equal_keys(spark):
    rows = [("", 9 - i, "usa", 1) for i in range(9)]
    df = spark.createDataFrame(rows, "id string, line_no int, s string, populated int").repartition(4)
    assert [r["line_no"] for r in datasets.prioritized(df, "s", {"usa": 1}, order=("line_no",)).collect()] == list(range(1, 10))


def test_leak_members_give_every_linked_pair(spark):
    train = [("a", "i"), ("a", "i"), ("b", "i"), ("c", "j"), ("d", None), ("e", "k"), ("", "l")]
    val = [("b", "i"), ("f", "i"), ("c", "j"), ("g", None), ("h", "k"), ("", "m")]
    found = {tuple(r) for r in datasets.leak_members(*(spark.createDataFrame(x, "id string, image_path string") for x in (train, val))).collect()}
    pairs = {("id", t, t, v) for (t, _), (v, _) in itertools.product(train, val) if t == v} | {("image", i, t, v) for (t, i), (v, j) in itertools.product(train, val) if i and i == j and t != v}
    sides = {(kind, value, x, s) for kind, value, t, v in pairs for x, s in ((t, "train"), (v, "val"))}
    wanted = {(kind, value, x, s, sum((k, w, (t, v)[s == "val"]) == (kind, value, x) for k, w, t, v in pairs)) for kind, value, x, s in sides}
    assert found == wanted and ("image", "i", "a", "train", 2) in found


def test_customers_are_dealt_to_all_cores(spark, sf):
    found = derive(spark, sf, PERSONS)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and found.count() == table(spark, sf, "customer").count()


def _named(df, literal):
    """How often the analysed plan names a literal."""
    return df._jdf.queryExecution().analyzed().toString().count(literal)


def test_costly_texts_are_worked_out_once(spark):
    df = spark.createDataFrame([("DOB 08/31/77",), (None,)], "t string")
    assert _named(df.select(invoice.schema(F.col("t")).alias("v")), "<pad>") == 1
    assert _named(df.select(dates.identity_date(F.concat("t", F.lit("@@")), F.array("t")).alias("v")), "@@") == 1
    assert _named(df.select(dates.ordinal(F.concat("t", F.lit("@@"))).alias("v")), "@@") <= 4


def test_dates_and_markers_at_their_borders(spark):
    said = ["00/10/2000", "13/10/2000", "12/31/2099", "12/32/2000", "01/00/1999", "01/01/1899", "01/01/2100", " 02/03/1900 ", "02/03/1900x", "\u0661\u0662/03/1900", "", None]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    got = {r["s"]: (r["o"], r["m"]) for r in df.select("s", dates.ordinal(F.col("s")).alias("o"), dates.mmddyyyy(F.col("s")).alias("m")).collect()}
    assert {s for s, (o, _) in got.items() if o} == {"12/31/2099", " 02/03/1900 "} and got["12/31/2099"] == (20991231, True)
    assert {s for s, (_, m) in got.items() if m} == {"12/31/2099", " 02/03/1900 ", "02/03/1900x"}
    lines = [["a", "the Name.", "b", "name", "c"], ["x", "NAMES"], [None, "name.", None], [], None, ["name", "y"]]
    found = spark.createDataFrame([(ls,) for ls in lines], "ls array<string>").select(text.value_after(F.col("ls"), ("NAME.", "NAME")).alias("v"))
    assert [r["v"] for r in found.collect()] == ["b", None, None, None, None, "y"]


def test_objects_are_bound_and_events_dealt(spark, sf):
    df = spark.createDataFrame([("x",)], "t string")
    assert _named(df.select(jsonops.object_text(F.concat("t", F.lit("@@"))).alias("v")), "@@") == 1
    found = answers.trimmed_objects(spark, sf)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and found.count() == table(spark, sf, "events").count()
    said = ['a {"a": 1} ', '{"a": [1,], }', '{"a": {"b": 1', '{"a": "}"}', "{", "}", '{"a": 1} {', None, '{"a": 1, "b": "x} y', '{"a": 1}] x', '{"a": 1}] }', '{"a": 1}, 0] }']
    got = dict(map(tuple, spark.createDataFrame([(t,) for t in said], "t string").select("t", jsonops.object_text(F.col("t")).alias("v")).collect()))
    assert [got[t] for t in said] == ['{"a": 1}', '{"a": [1]}', '{"a": {"b": 1}}', '{"a": "}"}', "{}", None, '{"a": 1}', None, None, '{"a": 1}', None, None]


def test_truths_are_parsed_once_and_orders_dealt(spark, sf):
    df = spark.createDataFrame([("x",)], "t string")
    assert _named(df.select(invoice.simplified(F.concat("t", F.lit("@@")), True).alias("v")), "@@") <= 6
    found = scores.invoice_truths(spark, sf)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and found.count() == table(spark, sf, "orders").count()
    said = ['{"total_vat": {"a": [1]}, "items": 3, "iban": null, "header": [1], "item_vat": "q\\""}', '{"summary": {"a": 1}, "total_vat": 2}', "[1]", "x", None]
    got = dict(map(tuple, spark.createDataFrame([(t,) for t in said], "t string").select("t", invoice.simplified(F.col("t"), True).alias("v")).collect()))
    assert [got[t] for t in said] == ['{"header":{"iban":null},"items":[{"item_vat":"q\\""}],"summary":{"total_vat":{"a":[1]}}}', '{"summary":{"a":1}}', "{}", "{}", None]


def test_members_of_open_buckets_are_joined_once(spark, monkeypatch):
    # each of two far values in one bucket has its own near ones, so that the bucket stays open
    near = [base | 1 << b for base in (0, 0xFF << 50) for b in range(40, 44)]
    joins = []

    def kept(df, name, write=simhash.written):
        joins.append((name, df._jdf.queryExecution().analyzed().toString().count("Join ")))
        return write(df, name)

    monkeypatch.setattr(simhash, "written", kept)
    found = simhash.links(spark.createDataFrame([(x,) for x in near], "print long"), block=2).collect()
    root = {x: x for x in near}
    for _ in near:
        for a, b in found:
            root[a] = root[b] = min(root[a], root[b])
    assert [*map(root.get, near)] == [near[0]] * 4 + [near[4]] * 4
    assert sum(n for name, n in joins if name == "placed") == 1 and joins[-1] == ("links", 0)


def test_repeats_whose_one_anchor_ends_them(spark):
    """A string of exactly 400 bytes whose last gram has the least hash, behind a byte that leaves it no other anchor."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    anchors = lambda t: suffix_dedup.anchors(t.encode())[0].tolist()
    while True:
        shared = text(400)
        before = next((c for c in map(chr, range(48, 91)) if anchors(shared) == [304] and anchors(c + shared) == [0, 305]), None)
        if before:
            break
    docs = spark.createDataFrame([(1, text(500) + before + shared + "#" + text(500)), (2, text(500) + "!" + shared + "%" + text(500)), (3, text(1402))], "doc_id long, text string")
    for many in (1, 50_000):
        assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.report(docs, many=many).collect()} == {1: (400, 1), 2: (400, 1), 3: (0, 0)}


def test_report_gives_passages_under_400_bytes(spark):
    """Passages of 51 words, with other blanks and line breaks; 50 words don't count, and the contract's columns stay as they are."""
    rng = random.Random(6)
    words = lambda n: rng.choices(["ab", "cde", "fghij", "klmnop"], k=n)
    long, short, own = words(51), words(50), words(60)
    said = [(" ".join(words(30)) + f" x{i} ", f" y{i} " + " ".join(words(30))) for i in range(8)]
    middle = [" ".join(long), "\n".join(long), " ".join(short), " ".join(short), "  ".join(own) + " mid " + " ".join(own), "", " ".join(long) + " mid " + " ".join(short), "\t".join(words(51))]
    docs = spark.createDataFrame([(i, a + m + b) for i, ((a, b), m) in enumerate(zip(said, middle))] + [(8, None), (9, "")], "doc_id long, text string")
    n = len(" ".join(long))
    assert n < 400
    want = {i: (0, 0) for i in range(10)} | {0: (1, n), 1: (1, n), 6: (1, n), 4: (2, len("  ".join(own)) + len(" ".join(own)))}
    for many in (1, 50_000):
        found = suffix_dedup.report(docs, words=50, many=many).collect()
        assert {r["doc_id"]: (r["n_passages"], r["n_passage_bytes"]) for r in found} == want
        assert sorted(tuple(r)[:5] for r in found) == sorted(map(tuple, suffix_dedup.report(docs, many=many).collect())) and not any(r["n_removed"] for r in found)
