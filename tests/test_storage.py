"""Splits, profiles, manifests and scores on literal cases; the similarity of tagged answers computed anew."""

import json
import os
import subprocess
import sys
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from scriptorium.functions import trees
from scriptorium.operators import datasets, imports, metrics
from scriptorium.plans import queries, scores
from scriptorium.sources import reports


def test_shuffle_split(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), F.col("id") % 100).alias("id"), F.lit(1).alias("at"), F.lit("x").alias("last"), F.lit("old").alias("split"))
    split = datasets.shuffle_split(df, 0.1, seed=3)
    assert split.columns == ["id", "at", "last", "split"] and split.count() == 500
    val = {r["id"] for r in split.where("split = 'val'").collect()}
    assert len(val) == 10 and split.where("split = 'val'").count() == 50
    assert val == {r["id"] for r in datasets.shuffle_split(df.repartition(5), 0.1, seed=3).where("split = 'val'").collect()}
    assert val != {r["id"] for r in datasets.shuffle_split(df, 0.1, seed=4).where("split = 'val'").collect()}
    few = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    assert sorted(map(str, datasets.shuffle_split(few, 0.1).collect())) == ["Row(id='a', split='val')", "Row(id='a', split='val')", "Row(id=None, split='train')"]
    assert {r["split"] for r in datasets.shuffle_split(few.where("id is null"), 0.5).collect()} == {"train"}
    assert datasets.shuffle_split(few.limit(0), 0.5).count() == 0
    assert datasets.shuffle_split(df, 1.0).where("split = 'val'").count() == 500


def test_profile(spark):
    df = spark.createDataFrame([("s", "x", "1"), ("s", None, ""), (None, "x", None)], "g string, v string, f string")
    found = {r["g"]: r.asDict() for r in datasets.profile(df, "g", {"v": F.col("v"), "is_set": F.col("f") != ""}, ("f", "v")).collect()}
    assert found["s"] == {"g": "s", "n_rows": 2, "counts": {"v": {"None": 1, "x": 1}, "is_set": {"true": 1, "false": 1}}, "coverage": {"f": 1, "v": 1}}
    assert found["None"] == {"g": "None", "n_rows": 1, "counts": {"v": {"x": 1}, "is_set": {"None": 1}}, "coverage": {"v": 1}}
    assert datasets.profile(df.limit(0), "g", {"v": F.col("v")}, ("f",)).count() == 0
    alone = datasets.profile(df, "g", {}, ("f",)).where("g = 's'").first()
    assert alone["counts"] == {} and alone["coverage"] == {"f": 1}


def test_manifest(spark):
    df = spark.createDataFrame([("a/1.png",), ("a/1.png",), ("b\\2.png",), ("",), (None,), ("c.png",)], "image_path string")
    assert reports.manifest({"x": df, "y": df.limit(0)}).first().asDict() == {"n_rows": {"x": 6}, "image_count": 3, "image_roots": ["a", "b", "c.png"]}
    assert reports.manifest({"y": df.limit(0)}).first().asDict() == {"n_rows": {}, "image_count": 0, "image_roots": []}


def test_json_scores(spark):
    rows = [('{"a": "1"}', "<s_a>1</s_a>"), ('{"a": "1"}', "<s_a>2</s_a>"), ("{bad", "<s_a>1</s_a>"), ('{"a": "1"}', ""), ('{"a": "1"}', None), (None, None), ('{"a": "1", "b": "2"}', "<s_b>2</s_b><s_a>1</s_a>")]
    found = spark.createDataFrame(rows, "t string, p string").coalesce(1).select(trees.json_scores(F.col("t"), F.col("p")).alias("s")).collect()
    assert [(r["s"]["exact"], r["s"]["field_f1"]) for r in found] == [(True, 1.0), (False, 0.0), (False, 0.0), (False, 0.0), (False, 0.0), (False, 0.0), (True, 1.0)]
    assert found[1]["s"]["similarity"] == SequenceMatcher(None, '{"a":"1"}', '{"a":"2"}').ratio() and found[5]["s"]["similarity"] == 1.0 and found[3]["s"]["similarity"] == 0.0
    leaves = spark.createDataFrame([("{}",), ('{"a": [0, false, " ", null, {"b": "x"}]}',), ('"x"',), (None,), ("{",)], "t string").coalesce(1)
    assert [r["n"] for r in leaves.select(trees.populated_leaves("t").alias("n")).collect()] == [0, 3, 1, 0, 0]


def test_tagged_similarity(spark, sf):
    rows = {r["id"]: r for r in queries.derive(spark, sf, scores._TAGGED).collect()}
    found = {r["id"]: r["similarity"] for r in queries.QUERIES["tagged_similarity"](spark, sf).collect()}
    assert found.keys() == rows.keys()
    plain = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    for i, r in rows.items():
        said = r["answer"]
        if said and said.startswith("<"):
            t = json.loads(r["truth"])
            got = {"name": t["name"] + ("x" if i % 7 == 1 else ""), "to": dict(t["to"])} | ({"more": "1"} if i % 7 == 3 else {})
            if i % 7 == 2:
                del got["to"]["nation"]
            said = plain(got)
        elif said:
            said = plain(said)  # without any tag the answer is one string
        assert abs(found[i] - (SequenceMatcher(None, plain(json.loads(r["truth"])), said).ratio() if said else 0.0)) < 1e-12, i


def test_scores_without_rows(spark):
    cells = spark.createDataFrame([("e", 1, "a", True, 1.0)], "engine string, id int, key string, match boolean, soft double")
    assert sorted(map(tuple, metrics.by_field(cells, ("a", "b")).collect())) == [("e", "a", 1, 1, 1.0, 1.0), ("e", "b", 0, 0, 0.0, 0.0)]
    docs = spark.createDataFrame([("e", 1), ("e", 2), ("f", 1)], "engine string, id int")
    assert sorted(map(tuple, metrics.by_document(cells, docs).collect())) == [("e", 2, 1.0, 0.5), ("f", 1, 1.0, 0.0)]
    assert metrics.by_field(cells.limit(0), ("a",)).count() == 0 and metrics.by_document(cells.limit(0), docs.limit(0)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "train", 7), (2, "train", 8)], "line_no int, split string, last int").withColumns({"vals": F.lit(1), "place": F.lit(9), "row": F.lit("r")})
    found = datasets.fallback_split(df)
    assert sorted(found.columns) == sorted(df.columns) and {r["line_no"]: (r["split"], r["last"], r["vals"]) for r in found.collect()} == {1: ("train", 7, 1), 2: ("val", 8, 1)}
    rows = spark.createDataFrame([(1, "old/x.png"), (2, "none.png"), (3, None)], "id int, image_path string").withColumns({c: F.lit(0) for c in ("_best", "_raw", "_rank", "path")})
    listing = spark.createDataFrame([("root/x.png",)], "path string")
    moved = imports.remapped(rows, listing, "root", ("old/",))
    assert moved.columns == rows.columns and {r["id"]: r["image_path"] for r in moved.collect()} == {1: "root/x.png", 2: "none.png", 3: None}


def test_any_module_of_queries_can_come_first():
    """Workers load the module of a function first, not `queries`."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("answers", "identity", "operations", "queries", "records", "scores", "storage"):
        subprocess.run([sys.executable, "-c", f"import scriptorium.plans.{name}"], cwd=root, check=True)
