"""Field maps, trees, ratios, licence dates and two-edit repair on literal cases."""

import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import dates, mrz, payload, trees
from scriptorium.operators import datasets
from scriptorium.plans import queries

SPECIMEN = "L898902C36UTO7408122F1204159ZE184226B<<<<<10"


def values(spark, column, rows, schema):
    return [r["x"] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column.alias("x")).collect()]


def test_normalize(spark):
    rows = [
        ("driver_license", {"DL Number": "no Y1234567 x", "DOB": "1", "fn": "___", "addr": "01/02/2000", "Class": "B, C1 B"}),
        ("passport", {"Passport No": "AB12345678", "given names": "<<", "document_time": "12:00", "Family Name": "aaaa", "LASTNAME": "Roe"}),
        ("id_card", {"expiry_date": "x", "personal number": "7"}),
        ("other", {"Foo Bar": " v ", "gender": "F"}),
        ("passport", None),
        ("passport", {}),
        (None, {"a": None, "b": "1"}),
    ]
    field_map = F.from_json("m", "map<string,string>")  # keeps the order of its keys
    run = lambda rows, profile: values(spark, payload.normalize(F.col("k"), field_map, profile), [(k, m if m is None else json.dumps(m)) for k, m in rows], "k string, m string")
    service = run(rows, "service")
    assert service == [{"license_number": "Y1234567", "date_of_birth": "1", "categories": "B,C1"}, {"document_number": "AB12345678", "surname": "Roe"}, {"date_of_expiry": "x", "personal_number": "7"}, {"Foo Bar": "v", "sex": "F"}, None, {}, {"b": "1"}]
    hidden = [("passport", {"last name": "Roe", "family name": "N/A"}), ("passport", {"surname": "aaaa", "issue_date": "5"}), ("driver_license", {"class": "AB DL"})]
    assert run(hidden, "service")[:2] == [{}, {"date_of_issue": "5"}]
    assert run(hidden, "evaluator") == [{"surname": "Roe"}, {"surname": "aaaa", "date_of_issue": "5"}, {"categories": "AB"}]


def test_gates(spark):
    m = F.col("m")
    rows = [({"surname": "A", "Sex": "", "license_number": "7", "x": "1", "y": "2"},), ({},), (None,)]
    assert values(spark, payload.populated(m), rows, "m map<string,string>") == [4, 0, 0]
    assert [g["is_valid"] for g in values(spark, payload.identity_gate(m), rows, "m map<string,string>")] == [True, False, False]
    assert sorted((e["key"], e["value"]) for e in values(spark, payload.entities(m), rows[:1], "m map<string,string>")[0]) == [("document.number", "7"), ("person.surname", "A")]
    assert values(spark, payload.first_present(m, ("sex", "surname")), rows, "m map<string,string>") == [None, None, None]
    assert values(spark, payload.first_present(m, ("none", "SURNAME")), rows, "m map<string,string>") == ["A", None, None]
    assert values(spark, payload.loops(F.col("t")), [("<s_a>" * 20,), ("<s_a>" * 19 + "<s_b>",), ("",), (None,)], "t string") == [True, False, False, False]
    assert values(spark, payload.upload_code(F.col("n"), F.col("m"), 10, ("image/png",)), [(0, "x"), (None, "x"), (11, "x"), (5, "x"), (5, "image/png")], "n int, m string") == [400, 400, 413, 415, 200]
    assert values(spark, payload.infer_type(F.col("t")), [("PP_x",), ("my_idcard",), ("rp_1",), ("z",)], "t string") == ["passport", "id_card", "id_card", "other"]


def test_trees(spark):
    text = ['{"a": {"b": [1, null, "x"], "c": [{"d": true}], "e": [], "f": null}, "g": 1.5}', "[1, 2]", "{bad", None]
    rows = [(t,) for t in text]
    assert values(spark, trees.flatten("t"), rows, "t string") == [{"a.b": "1,None,x", "a.c[0].d": "True", "g": "1.5"}, {"": "1,2"}, None, None]
    assert values(spark, trees.flat_pairs("t"), rows[:1], "t string") == [["a.b[0]=1", "a.b[1]=None", "a.b[2]=x", "a.c[0].d=True", "a.f=None", "g=1.5"]]
    assert values(spark, trees.canonical("t"), [('{"b": 1, "a": "é"}',)], "t string") == ['{"a":"é","b":1}']
    tagged = ["<s_a>1</s_a><s_b><s_c> x </s_c></s_b></s_z>", "<s_a>1</s_a><s_a>2</s_a><s_l><s_item><s_n>1</s_n></s_item></s_l>", "hello <s_a>1</s_a>", "<s_a>1</s_a> tail", "", None]
    found = [t and json.loads(t) for t in values(spark, trees.parse_tags("t"), [(t,) for t in tagged], "t string")]
    assert found == [{"a": "1", "b": {"c": "x"}}, {"a": ["1", "2"], "l": {"items": [{"n": "1"}]}}, "hello", {"a": "1", "value": "tail"}, None, None]


def test_similarity(spark):
    rows = [("a1-23", "123"), ("12", ""), (None, "1"), ("12", "13")]
    assert values(spark, trees.digit_similarity(F.col("a"), F.col("b")), rows, "a string, b string") == [1.0, 0.0, 0.0, 0.5]
    rows = [("1/2/2020", "01/2/2020"), ("5.6", "5/6"), (None, "1.1.2000"), ("", "")]
    assert values(spark, trees.date_similarity(F.col("a"), F.col("b")), rows, "a string, b string") == [pytest.approx(2 / 3), 1.0, 0.0, 0.0]


def test_identity_dates(spark):
    lines = ["03151984", "05061777"]
    cases = {"03/15/1984": "03/15/1984", "03/15/3984": "03/15/1984", "01/01/1784": "01/01/1984", "01/01/2284": "01/01/2084", "01/01/0084": "01/01/0084", "01/02/11984": "01/02/1984", "01/02/231984": "01/02/1984", "03/15/984": "03/15/1984", "01/02/984": "01/02/1984", "01/02/29": "01/02/2029", "01/02/30": "01/02/1930", "05/06/99": "05/06/1777", "on 12312001": "12/31/2001", "99999999": "99999999", "none": None, "": None}
    found = values(spark, dates.identity_date(F.col("t"), F.array(*map(F.lit, lines))), [(t,) for t in cases], "t string")
    assert dict(zip(cases, found)) == cases
    assert values(spark, dates.dotted(F.col("t")), [("5 mar 2020",), ("1/2/2020",), ("5 XXX 2020",), (None,)], "t string") == ["05.03.2020", "01.02.2020", "5 XXX 2020", None]
    ls = ["DOB 01/02/1980", "EXP 01/02/2030", "seen 03/04/2019 05/06/2020", "ISS"]
    row = spark.range(1).select(F.array(*map(F.lit, ls)).alias("ls"))
    got = row.select(dates.birth_date(F.col("ls"), F.lit(None).cast("string"), F.lit("01/02/2030")).alias("b"), dates.issue_date(F.col("ls"), F.lit("01/02/1980"), F.lit("01/02/2030")).alias("i")).first()
    assert (got["b"], got["i"]) == ("01/02/1980", "05/06/2020")


def test_better_dates(spark):
    c, o = F.col("c"), F.col("o")
    rows = [("01/01/1980", "01/01/1990"), ("01/01/1980", None), (None, "01/01/1990"), ("01/01/1990", "01/01/1925"), ("01/01/1925", "01/01/1990"), ("01/01/2050", "01/01/1990")]
    assert values(spark, dates.better_identity_date(c, o, True), rows, "c string, o string") == [True, True, False, False, True, False]
    assert values(spark, dates.better_identity_date(c, o, False), rows, "c string, o string") == [False, True, False, True, False, False]
    between = dates.better_issue_date(c, o, F.lit("01/01/1970"), F.lit("01/01/2000"))
    assert values(spark, between, [("01/01/1980", "01/01/1990"), ("01/01/1960", None), ("01/01/1995", "01/01/2010"), ("01/01/1995", None)], "c string, o string") == [True, False, True, True]


def test_pairs(spark):
    two = "L89B902C36UTO74O8122F1204159ZE184226B<<<<<10"
    df = spark.createDataFrame([(1, SPECIMEN), (2, two), (3, "X" * 44)], "id int, l2 string")
    found = {r["id"]: r for r in mrz.repair_pairs(df, "l2", "id").collect()}
    assert found[1]["n_edits"] == 0 and found[3]["n_edits"] == -1
    assert found[2]["n_edits"] in (1, 2)
    checked = df.sparkSession.createDataFrame([(found[2]["fixed"],)], "l2 string").select(mrz.line2_valid(F.col("l2"))).first()[0]
    assert checked
    by_force = next((e2 for e1 in singles(two) for e2 in singles(e1) if valid(e2)), None)
    assert found[2]["fixed"] == by_force


def singles(line):
    return [line[:i] + a + line[i + 1 :] for i, c in enumerate(line) for a in mrz.CONFUSIONS.get(c, "")]


def valid(line):
    digit = lambda s: str(sum((7, 3, 1)[i % 3] * (0 if c == "<" else int(c, 36)) for i, c in enumerate(s)) % 10)
    return digit(line[:9]) == line[9] and digit(line[13:19]) == line[19] and digit(line[21:27]) == line[27] and digit(line[:10] + line[13:20] + line[21:43]) == line[43]


def test_fallback_split(spark):
    df = spark.createDataFrame([(1, "train"), (2, "train")], "line_no int, split string")
    assert sorted(map(tuple, datasets.fallback_split(df).collect())) == [(1, "train"), (2, "val")]
    assert sorted(map(tuple, datasets.fallback_split(df.where("line_no = 1")).collect())) == [(1, "train")]
    assert datasets.fallback_split(df.limit(0)).count() == 0
    ranked = datasets.prioritized(spark.createDataFrame([("a", "x-usa", 1), ("b", "other", 9), ("c", "x-usa", 3)], "id string, s string, populated int"), "s", {"usa": 1})
    assert [r["id"] for r in ranked.collect()] == ["c", "a", "b"]


def test_merge(spark):
    rows = [
        ("passport", {"a": "1", "b": ""}, {"b": "2", "c": "", "d": "4"}),
        ("invoice", {"a": "1"}, {"b": "2"}),
        ("driver_license", {"license_number": "01021980", "date_of_birth": "01/01/1990", "date_of_expiry": "01/01/2024"}, {"license_number": "Y1", "date_of_birth": "01/01/1980", "date_of_expiry": "01/01/2020", "date_of_issue": "05/05/2015"}),
        ("id_card", None, {"x": "1"}),
        ("id_card", {"x": "1"}, None),
    ]
    found = values(spark, payload.merge(F.col("k"), F.col("p"), F.col("f")), rows, "k string, p map<string,string>, f map<string,string>")
    assert found == [{"a": "1", "b": "2", "d": "4"}, {"a": "1"}, {"license_number": "Y1", "date_of_birth": "01/01/1980", "date_of_expiry": "01/01/2024", "date_of_issue": "05/05/2015"}, {"x": "1"}, {"x": "1"}]


def test_queries_without_sql(spark, sf):
    only = lambda t: "".join(c for c in t if c.isdigit())
    score = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    given = [(r["id"], r["n"], score(only(r["guess"]), only(r["truth"]))) for r in queries.derive(spark, sf, queries.AMOUNTS).collect()]
    assert sorted(map(tuple, queries.amount_digit_ratio(spark, sf).collect())) == sorted(given)
    lines = {r["id"]: r["l2"] for r in queries.zones(spark, sf).collect()}
    found = queries.mrz_repair_pairs(spark, sf).collect()
    assert len(found) == len(lines)
    for r in found:
        line = lines[r["id"]]
        once = line if valid(line) else next(filter(valid, singles(line)), None)
        assert r["fixed"] == (once or next((e2 for e1 in singles(line) for e2 in singles(e1) if valid(e2)), line))
