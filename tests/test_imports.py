"""Imports and reports that have no query over the driver's tables."""

from pyspark.sql import functions as F

from scriptorium.functions import evaluation, jsonops
from scriptorium.operators import imports, reports


def test_numbered_lines(spark, tmp_path):
    """Line numbers are those of the file, blank lines included, however it is split."""
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" if i % 7 else "\n" for i in range(1, 20001)))
    (tmp_path / "b.txt").write_text("one\n\nthree")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = imports.numbered_lines(spark, f"file://{tmp_path}").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    a = {r["line_no"]: r["value"] for r in found if r["path"].endswith("a.txt")}
    assert a == {i: str(i) if i % 7 else "" for i in range(1, 20001)}
    assert sorted((r["line_no"], r["value"]) for r in found if r["path"].endswith("b.txt")) == [(1, "one"), (2, ""), (3, "three")]


def test_images(spark):
    paths = ["x/b.png", "x/b.jpg", "x/a.jpg", "metadata/c.jpg", "x/metadata/d.jpg", "x/e.txt"]
    assert [r["path"] for r in imports.images(spark.createDataFrame([(p,) for p in paths], "path string")).collect()] == ["x/a.jpg", "x/b.jpg", "x/b.png"]


def test_sample_is_stable(spark):
    df = spark.range(1000)
    one, two = ({r["id"] for r in reports.sample_k(d, 20).collect()} for d in (df, df.repartition(7)))
    assert one == two and len(one) == 20 and reports.sample_k(df.limit(0), 5).count() == 0


def test_best_epoch(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([5.0, 3.0, 4.0, 3.0, 6.0, 1.0])] + [("b", 0, 2.0)], "run string, epoch int, loss double")
    assert sorted(tuple(r) for r in reports.best_epoch(df).collect()) == [("a", 1, 3.0, 4), ("b", 0, 2.0, None)]


def test_nulls(spark):
    df = spark.createDataFrame([(None, None)], "k string, v string")
    row = df.select(evaluation.exact_match(F.col("k"), F.col("v"), F.col("v")), evaluation.zone_valid(F.col("v")), evaluation.is_zone_job(F.col("v")), evaluation.percent(F.lit(None).cast("double")), jsonops.salvage(F.col("v"))).first()
    assert tuple(row) == (None, False, False, "—", None)
