"""Small literal cases of the Column functions and operators, nulls and empties included."""

import json

from pyspark.sql import functions as F

from scriptorium.functions import dates, jsonops, mrz, text
from scriptorium.operators import datasets, metrics
from scriptorium.sources import tables
from scriptorium.streaming import worker

L1 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"
L2 = "L898902C36UTO7408122F1204159ZE184226B<<<<<10"


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_specimen(spark):
    assert one(spark, mrz.check_digit(F.col("s")), s="L898902C3") == "6"
    found = one(spark, mrz.validate(F.col("a"), F.col("b")), a=L1, b=L2)
    assert found["valid"] and found["cd_personal"] and found["len_l2"] == 44
    fields = one(spark, mrz.parse(F.col("a"), F.col("b"), 2025), a=L1, b=L2)
    assert (fields["surname"], fields["given_names"], fields["document_number"], fields["date_of_birth"], fields["date_of_expiry"], fields["sex"]) == ("ERIKSSON", "ANNA MARIA", "L898902C3", "1974-08-12", "2012-04-15", "F")


def test_split_lines(spark):
    split = lambda t: tuple(one(spark, mrz.split_lines(F.col("t")), t=t))
    assert split(f"noise\n{L1}\n{L2}\n") == (L1, L2)
    assert split(L1 + L2) == (L1, L2)
    assert split(L1[:30]) == (L1[:30], "")
    assert split("") == ("", "")


def test_repair(spark):
    wrong = L2.replace("7408122", "74O8122")
    df = spark.createDataFrame([(1, L2), (2, wrong), (3, "X" * 44)], "id int, l2 string")
    found = {r["id"]: r for r in mrz.repair(df, "l2", "id").collect()}
    assert found[1]["n_edits"] == 0 and found[1]["fixed"] == L2
    assert found[2]["n_edits"] == 1 and found[2]["fixed"] == L2 and found[2]["n_candidates"] >= 1
    assert found[3]["n_edits"] == -1


def test_text(spark):
    c = F.col("t")
    assert one(spark, text.squash(c), t=" a \n b ") == "a b"
    assert one(spark, text.squash(c), t="   ") is None
    assert one(spark, text.sanitized(c), t="xxx") is None and one(spark, text.sanitized(c), t=" N/A ") is None
    assert one(spark, text.tag(c, "b"), t="<b> x </b>") == "x" and one(spark, text.tag(c, "b"), t="<b></b>") == "" and one(spark, text.tag(c, "b"), t="b") is None
    assert one(spark, text.same_or_next(text.lines(c), ("SEX",)), t="Name\nSex: F\n") == "F"
    assert one(spark, text.same_or_next(text.lines(c), ("SEX",)), t="Sex:\nM") == "M"
    assert one(spark, text.value_after(text.lines(c), ("NAME",)), t="a name\n\nANNA") == "ANNA"
    assert one(spark, text.value_after(text.lines(c), ("NAME",)), t="") is None


def test_dates_and_amounts(spark):
    c = F.col("t")
    assert one(spark, dates.mrz_iso(c, 2025), t="740230") is None
    assert one(spark, dates.compact_slashes(c), t="120426") == "12/04/2026"
    assert one(spark, dates.ordinal(c), t="02/31/2020") == 20200231 and one(spark, dates.ordinal(c), t="13/01/2020") is None
    assert one(spark, dates.amount(c), t="$ 1.234,50") == 1234.5 and one(spark, dates.amount(c), t="n/a") is None
    assert one(spark, dates.amount_text(c), t="sum 1.234,50 EUR") == "$ 1.234,50"


def test_json(spark):
    c = F.col("t")
    assert json.loads(one(spark, jsonops.object_text(c), t='x {"a": {"b": 1,}, ')) == {"a": {"b": 1}}
    assert one(spark, jsonops.object_text(c), t="no object") is None
    assert one(spark, jsonops.salvage(c), t='{"a": "1", "b": " ", "a": " 2 ", "type": "x", "text": "y", "document_type": "z"') == {"a": "2", "type": "x"}


def test_first_wins_and_splits(spark):
    rows = [("a", 1, 1, "s"), ("a", 1, 2, "s"), ("", 1, 3, None), ("", 1, 4, None), (None, 2, 5, "t"), ("b", 2, 6, "s")]
    df = spark.createDataFrame(rows, "id string, file_no int, line_no int, source_dataset string")
    assert sorted(r["line_no"] for r in datasets.first_wins(df).collect()) == [1, 3, 4, 5, 6]
    split = {r["line_no"]: r["split"] for r in datasets.last_of_group_split(df.where("id <> ''")).collect()}
    assert split == {1: "train", 2: "train", 6: "val"}
    assert datasets.first_wins(df.limit(0)).count() == 0


def test_metrics_invariant(spark):
    e = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", None), (2, "b", "z")], "id int, key string, value string")
    p = spark.createDataFrame([("m", 1, "a", "x"), ("m", 1, "c", "q"), ("n", 2, "b", "z")], "engine string, id int, key string, value string")
    found = {(r["engine"], r["id"]): r for r in metrics.per_document(e, p).collect()}
    assert all(r["recall"] == r["field_accuracy"] for r in found.values())
    assert (found["m", 1]["precision"], found["m", 1]["recall"]) == (0.5, 0.5) and found["n", 2]["f1_score"] == 1.0 and found["m", 2]["f1_score"] == 0.0


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é")], "id int, v string")
    tables.write_jsonl(df, f"{tmp_path}/x")
    assert sorted(tables.read_jsonl(spark, f"{tmp_path}/x", "id int, v string").collect()) == sorted(df.collect())


def test_stream_equals_batch(spark, sf, tmp_path):
    jobs = spark.read.parquet(f"{sf}/orders.parquet")
    jobs.repartition(3).write.parquet(f"{tmp_path}/in")
    step = lambda d: d.select("o_orderkey", F.upper("o_orderpriority").alias("p"))
    for _ in range(2):  # the second run finds nothing new
        worker.run_worker(spark, f"{tmp_path}/in", jobs.schema, step, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == jobs.count() and out.exceptAll(step(jobs)).count() == 0
