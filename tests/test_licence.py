"""Licence heuristics and flat answers on literal lines, with null and empty ones."""

from pyspark.sql import functions as F

from scriptorium.functions import licence, mrz
from scriptorium.sources import reports


def values(spark, column, rows):
    return [r["x"] for r in spark.createDataFrame([(r,) for r in rows], "ls array<string>").coalesce(1).select(column.alias("x")).collect()]


def test_categories(spark):
    rows = [["CLASS C extra A", "Category B, C1 B", "no A1"], ["CLASS: D1 T"], ["none"], [], None]
    assert values(spark, licence.categories(F.col("ls")), rows) == [["C", "B"], ["D1", "T"], [], [], None]


def test_number(spark):
    rows = [["12345678", "x"], ["DL", "7654321", "EXP"], ["01021980", "1234567", "12345678"], ["01021980"], ["DRIVER Y1234567"], ["abc", "99999999"], [], None]
    found = values(spark, licence.fallback_number(F.col("ls"), F.array(F.lit("99999999"))), rows)
    assert found == ["12345678", "7654321", "12345678", "01021980", "Y1234567", None, None, None]


def test_address_and_surname(spark):
    rows = [["1 A", "FN ANNA", "DOB 1", "x", "12 MAIN ST", "9 B"], ["FN", "a", "b", "c", "d", "5 late"], [], None]
    assert values(spark, licence.address(F.col("ls")), rows) == ["12 MAIN ST", None, None, None]
    rows = [["ROE", "Nationality", "A1", "Given names"], ["Given names", "X"], [], None]
    assert values(spark, licence.surname_before(F.col("ls")), rows) == ["ROE", None, None, None]


def test_flat_answer(spark):
    rows = [["sex: F", "SEX : M", "name : null", "other: x", "mrz:", "bad"], [], None]
    assert values(spark, licence.flat_answer(F.col("ls"), ("sex", "name", "mrz")), rows) == [{"sex": "M"}, {}, None]


def test_answer_lines(spark):
    a, b = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
    cases = {f"x\n{a}\n{b}\n{a}": (a, b), a + b: (a, b), b: (b, None), "null": None, "short": None, "": None, f"{a[:19]} \n{a[19:38]}\n{a[38:]}": (a, None)}
    found = [r["x"] for r in spark.createDataFrame([(t,) for t in cases], "t string").coalesce(1).select(mrz.answer_lines(F.col("t")).alias("x")).collect()]
    assert [tuple(x) if x else None for x in found] == list(cases.values())


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, "i|1"), ("a", 2, None)], "route string, n int, image_path string")
    assert reports.markdown(df.orderBy("route"), "Rows", 25) == "## Rows\n\n| route | n | image_path |\n|-|-|-|\n| a | 2 |  |\n| b | 1 | i\\|1 |\n"
    assert reports.markdown(df.limit(0), "None", 25).count("\n") == 4
    bundle = reports.bundle([df, df.where("n = 1")], "image_path")
    assert [r["image_path"] for r in bundle.collect()] == ["i|1"]
    reports.write_json(df, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 2
