"""Engines, reused results, metadata files, counted rejects, curation and the status stream."""

import json

from pyspark.sql import functions as F

from scriptorium.functions import display
from scriptorium.operators import datasets, engines, imports, memo, reports, zones
from scriptorium.sources import metadata
from scriptorium.sources.shared import exists, stream_of
from scriptorium.streaming import status, worker


def test_engines(spark, tmp_path):
    """A worker loads only the engines that its rows name, each once; errors stay with their rows."""

    def counting(name):
        def make():
            with open(f"{tmp_path}/{name}", "a") as f:
                f.write("x")
            return lambda raw: f"{name} {len(raw)}"

        return make

    def failing():
        raise RuntimeError("")

    rows = [(i, ["a", "b", "zz", None, "bad"][i % 5], b"x" * i) for i in range(50)] + [(None, "a", None)]
    df = spark.createDataFrame(rows, "id int, engine string, content binary").coalesce(1)
    found = engines.dispatched(df, {"a": counting("a"), "b": counting("b"), "c": counting("c"), "bad": failing}).collect()
    assert len(found) == 51 and {r["error"] for r in found if r["engine"] == "zz"} == {"Unsupported extraction engine: zz"} and {r["error"] for r in found if r["engine"] == "bad"} == {"RuntimeError"}
    assert all(r["text"] == f"{r['engine']} {r['id']}" for r in found if r["engine"] in ("a", "b") and r["id"] is not None)
    assert {p.name: len(p.read_text()) for p in tmp_path.iterdir()} == {"a": 1, "b": 1}
    plan = engines.dispatched(df, {"a": counting("a")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Exchange" not in plan.replace("ExchangeX", "")
    asked = spark.createDataFrame([("", "invoice"), (None, "passport"), ("q", "invoice"), (None, None)], "r string, k string").coalesce(1)
    assert [r[0] for r in asked.select(engines.wanted(F.col("r"), F.col("k"))).collect()] == ["donut", "paddleocr_vl", "q", "paddleocr_vl"]


def test_memo(spark, tmp_path):
    """A second run over a table with one more row computes one row; repeated content is computed once; the last run wins."""
    kept = memo.Memo(spark, f"{tmp_path}/memo", "said string")
    seen = []

    def compute(rows):
        seen.append(rows.count())
        return rows.select("memo_key", F.concat(F.lit(f"{len(seen)}:"), "result").alias("said"))

    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", "y")], "id int, result string, memo string")
    first, n = kept.apply(df, compute, memo.content_key("result"), 1)
    assert n == 2 and seen == [2] or seen[0] == 2
    more = df.select("id", F.col("result").alias("t")).unionByName(spark.createDataFrame([(4, "c"), (5, None)], "id int, t string"))
    second, n = kept.apply(more, lambda rows: rows.select("memo_key", F.concat(F.lit("2:"), F.coalesce("t", F.lit("-"))).alias("said")), memo.content_key(F.col("t").alias("result")), 2)
    assert n == 2
    assert {r["id"]: r["result"]["said"] for r in second.collect()} == {1: "1:a", 2: "1:b", 3: "1:a", 4: "2:c", 5: "2:-"}
    again = memo.Memo(spark, f"{tmp_path}/memo", "said string")
    again.apply(more.limit(0), lambda rows: rows.select("memo_key", F.lit("z").alias("said")), memo.content_key("t"), 3)
    assert again.read().count() == 4
    key = again.read().where("said = '1:a'").first()["memo_key"]
    spark.createDataFrame([(key, 9, "newer")], "memo_key string, run long, said string").write.mode("append").parquet(f"{tmp_path}/memo")
    assert again.read().where(F.col("memo_key") == key).first()["said"] == "newer"


def test_metadata_files(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.csv").write_bytes("﻿name;n\nÜé;1\n;\n\"x;y\";2\n".encode())
    (folder / "b.csv").write_bytes("имя,n\nИван,1\n".encode("cp1251"))
    (folder / "c.csv").write_bytes("name,n\nИ98,\"a b\"\n".encode())
    (folder / "d.json").write_text(json.dumps({"female": [{"name": "A", "n": 1}], "male": [{"name": "B"}, {"name": None}], "other": [{}]}))
    (folder / "e.json").write_text("[{\"name\": {\"x\": 1}}]")
    (folder / "f.json").write_text("{broken")
    (folder / "g.csv").write_text("")
    found = {}
    for r in metadata.read_rows(spark, f"file://{folder}").collect():
        found.setdefault(r["path"].rpartition("/")[2], []).append((r["row_no"], r["fields"], r["error"] and True))
    assert {k: sorted(v, key=lambda x: x[0] or 0) for k, v in found.items()} == {
        "a.csv": [(0, {"name": "Üé", "n": "1"}, None), (1, {"name": "x;y", "n": "2"}, None)],
        "b.csv": [(0, {"имя": "Иван", "n": "1"}, None)],
        "c.csv": [(0, {"name": "И98", "n": "a b"}, None)],
        "d.json": [(0, {"name": "B", "gender": "male"}, None), (1, {"name": None, "gender": "male"}, None), (2, {"name": "A", "n": "1", "gender": "female"}, None)],
        "e.json": [(0, {"name": '{"x": 1}'}, None)],
        "f.json": [(None, None, True)],
    }
    listing = spark.createDataFrame([("r", "metadata/b.csv"), ("r", "metadata/a.csv"), ("r", "x.csv"), ("s", "x/metadata/z.json"), ("t", "y.csv")], "repo string, path string")
    assert {r["repo"]: r["metadata_path"] for r in metadata.discovered(listing, "repo").collect()} == {"r": "metadata/a.csv", "s": "x/metadata/z.json"}
    keys = spark.createDataFrame([("a.csv",), ("none",), ("a.csv",)], "key string")
    assert {r["key"]: r["content"] and len(r["content"]) for r in metadata.blobs(spark, f"file://{folder}", keys).collect()} == {"a.csv": (folder / "a.csv").stat().st_size, "none": None}
    assert exists(spark, f"file://{folder}/a.csv") and not exists(spark, f"file://{folder}/zz")


def test_counted_rejects(spark):
    good, seen = metadata.scanned(spark.range(10).withColumn("x", F.when(F.col("id") > 2, F.col("id"))), F.col("x") % 2 == 0)
    assert good.count() == 3 and seen.get == {"n_rows": 10, "n_rejected": 7}


def test_splits_with_repeats_and_clashes(spark):
    df = spark.createDataFrame([("9", 1, 1, "s"), ("9", 1, 2, "s"), ("1", 1, 3, "s"), (None, 1, 4, None), ("5", 1, 5, "t")], "id string, file_no int, line_no int, source_dataset string").selectExpr("*", "1 AS _n", "2 AS _g", "'old' AS split", "3 AS row", "4 AS g")
    found = datasets.last_of_group_split(df)
    assert sorted(found.columns) == sorted(df.columns) and {r["line_no"]: r["split"] for r in found.collect()} == {1: "train", 2: "val", 3: "train", 4: "train", 5: "train"}
    t, v = found.where("split = 'train'"), found.where("split = 'val'")
    assert [tuple(r) for r in datasets.leakage(t.withColumn("image_path", F.lit("i")), v.withColumn("image_path", F.lit("i"))).orderBy("kind").collect()] == [("id", "9", 1, 1), ("image", "i", 3, 1)]
    rows = df.selectExpr("*", "'d' AS document_type", "1 AS populated", "false AS bootstrap_template", "'i' AS image_path", "1 AS _first", "2 AS _there")
    assert {(r["line_no"], r["issue"]) for r in datasets.issues(rows, rows).collect()} == {(2, "duplicate id"), (4, "missing id")}
    history = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 1.0)], "run string, epoch int, loss double").selectExpr("*", "1 AS _n", "2 AS _last", "3 AS n")
    assert [tuple(r) for r in reports.best_epoch(history).collect()] == [("a", 1, 1.0, None)]


def test_labels_and_truth(spark):
    lines = [(1, '{"image": "a", "mrz": "A\\n\\nB"}'), (2, '{"c": "C1\\r\\nC2", "d": ""}'), (3, '{"image": "a2", "line1": "x"}'), (4, " "), (5, '{"image": "a2", "line1": "y", "line2": "z"}')]
    found = imports.labels(spark.createDataFrame(lines, "n int, value string"), "n")
    assert {r["image"]: (r["line1"], r["line2"]) for r in found.collect()} == {"a": ("A", "B"), "c": ("C1", "C2"), "d": ("", ""), "a2": ("y", "z")}
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "e"), (4, "f")], "id int, image string").withColumn("line1", F.lit("old"))
    sides = spark.createDataFrame([("e", "s", "t"), ("e", "s", "a"), ("a", "no", "no")], "image string, line1 string, line2 string")
    assert {r["id"]: (r["line1"], r["line2"]) for r in imports.with_truth(df, found.unionByName(found), sides).collect()} == {1: ("A", "B"), 2: ("A", "B"), 3: ("s", "t")}


def test_shown_fields(spark):
    whole = {"a": {"b": True, "c": None}, "l": [1, 2.0, None], "o": [{"x": "y"}, [3.5]], "e": [], "n": 1e3}
    df = spark.createDataFrame([(json.dumps(whole),), (None,), ("{",), ("7",)], "t string").coalesce(1)
    found = [r["x"] for r in df.select(display.shown_fields(F.col("t")).alias("x")).collect()]
    assert [tuple(e) for e in found[0]] == [("a.b", "b", "true"), ("l", "l", "1, 2, null"), ("o[0].x", "x", "y"), ("o[1]", "o[1]", "3.5"), ("n", "n", "1000")]
    assert found[1:3] == [None, None] and [tuple(e) for e in found[3]] == [("", "", "7")]


def test_merged_pages(spark):
    rows = [(1, 2, "f2", [("k", "v", None)], ""), (1, 1, "f1", [("a", "b", "s")], "one"), (1, 3, None, None, "three"), (2, 5, "g", [], None)]
    df = spark.createDataFrame(rows, "doc_id int, page int, fields string, entities array<struct<key: string, value: string, source_field: string>>, raw_text string")
    found = {r["doc_id"]: (r["fields"], [tuple(e) for e in r["entities"]], r["raw_text"], r["raw_mode"], r["page_count"]) for r in worker.merge_results(df).collect()}
    assert found == {1: ("f1", [("a", "b", "s"), ("k", "v", "page2:k")], "one\n\nthree", "multipage", 3), 2: ("g", [], "", None, 1)}


def test_zone_pipeline(spark):
    l1, l2 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
    rows = [(1, f"{l1}\n{l2}"), (2, f"{l1}\n{l2.replace('7408122', '74O8122')}"), (3, f"{l1}\n{l2.replace('7408122', '74O8I22')}"), (4, l2), (5, l1), (6, "x"), (7, None), (8, f"{l1}\n{'X' * 44}")]
    found = {r["k"]: r for r in zones.pipeline(spark.createDataFrame(rows, "k int, t string"), "t", "k", 2025).collect()}
    assert [(found[k]["split"], found[k]["n_edits"], found[k]["stage"]) for k in range(1, 9)] == [("two_lines", 0, "valid"), ("two_lines", 1, "valid"), ("two_lines", 2, "valid"), ("second_only", 0, "corrected"), ("first_only", None, "split"), ("none", None, "none"), ("none", None, "none"), ("two_lines", -1, "split")]
    assert found[3]["l2"] != rows[2][1].split("\n")[1] and found[4]["fields"]["document_number"] == "L898902C3" and found[6]["fields"] is None and found[8]["l2"] == "X" * 44
    shares = {r["stage"]: r["n"] for r in zones.shares(spark.createDataFrame([(s,) for s in ("valid", "valid", "none")], "stage string")).collect()}
    assert shares == {"valid": 2, "none": 1}


def test_status_stream_goes_on(spark, tmp_path):
    """Actions that come in three parts leave what one pass over all leaves, also where a run ends in the middle and a batch is repeated."""
    actions = ["create", "start", "finish", "retry", "start", "fail", "finish", "create"]
    log = [(job, n * 10 + job, actions[(n + job) % 8], f"d{n}") for n in range(24) for job in range(6)]
    df = spark.createDataFrame(log, "job long, seq long, action string, detail string").withColumn("at", F.timestamp_seconds("seq"))
    want = {}
    for job in range(6):
        state = ("", None, None, None, 0, 0)
        for r in df.where(F.col("job") == job).orderBy("seq").collect():
            state = status.applied(state, r["action"], r["at"], r["detail"])
        want[job] = state
    source, sink, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    for part in range(3):
        df.where(F.floor(F.col("seq") / 80) == part).coalesce(1).write.mode("append").parquet(source)
        status.run(stream_of(spark, source), sink, check).awaitTermination()
        status.run(stream_of(spark, source), sink, check).awaitTermination()  # nothing new
    found = {r["job"]: (r["status"], r["error"], r["finished_at"], r["result"], r["n_applied"], r["n_rejected"]) for r in status.states(spark, sink).collect()}
    assert found == want and sum(s[5] for s in want.values()) > 0
    assert sum(status.finished(status.states(spark, sink))) == 6
