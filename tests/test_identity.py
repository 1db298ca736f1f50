"""Identity records, tolerant zone readers, rules and typed records on literal cases; nulls, empty ones and clashing columns included."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import invoice, jsonops, mrz, rules, text, typed, zonetext
from scriptorium.operators import identity

STATES = {"USA": "UNITED STATES OF AMERICA", "D": "GERMANY", "ARE": "UNITED ARAB EMIRATES"}


def values(spark, column, rows, kind="string"):
    return [r["x"] for r in spark.createDataFrame([(r,) for r in rows], f"t {kind}").coalesce(1).select(column.alias("x")).collect()]


def test_rules(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "b"), (3, " ", None), (4, "stop", "b")], "id int, x string, y string")
    chosen = rules.compiled([rules.Rule("f", "x", F.col("x"), F.col("x") != "stop"), rules.Rule("f", "end", F.lit(None), F.col("x") == "stop", last=True), rules.Rule("f", "y", F.col("y")), rules.Rule("g", "y", F.col("y"))])
    assert [tuple(r) for r in df.select(chosen.alias("c")).select("c.f.value", "c.f.source", "c.g.source").collect()] == [("a", "x", None), ("b", "y", "y"), (None, None, None), (None, None, "y")]


def test_passport(spark):
    said = "UNITED STATES OF AMERICA\nPassport\nDOE\nGiven Names\nJANE\nNationality\nUSA\nDate of birth\n05 Feb 1965\nno 123456789\nDEPARTMENT OF STATE"
    zone = "P<USADOE<<JANE<ANN<<<<<<<<<<<<<<<<<<<<<<<<<<<\n1234567897USA650205F1604159<<<<<<<<"
    rows = [(1, said, zone, None, "F", None), (2, said, None, "Mary-Lou Smith", None, "Authority: 01/02/2003"), (3, None, None, None, None, None), (4, "", "", "", "", "")]
    df = spark.createDataFrame(rows, "row int, said string, zone string, names string, sex string, ls string").withColumn("n", F.lit(7))
    found = {r["row"]: r for r in identity.passports(df, "said", "zone", "names", "sex", "ls").collect()}
    one = found[1]["record"]
    assert (one["fields"]["surname"], one["fields"]["given_names"], one["sources"]["surname"], one["fields"]["document_number"], one["fields"]["nationality"]) == ("DOE", "JANE ANN", "line1", "123456789", "USA")
    assert one["is_valid"] and one["code"] == "heuristic_passport_mapping" and found[1]["n"] == 7
    two = found[2]["record"]
    assert (two["fields"]["surname"], two["fields"]["given_names"], two["fields"]["date_of_birth"], two["fields"]["date_of_issue"], two["sources"]["date_of_issue"]) == ("DOE", "JANE", "05 Feb 1965", "01/02/2003", "authority")
    for k in (3, 4):
        assert found[k]["record"]["populated"] == 0 and not found[k]["record"]["is_valid"] and not any(found[k]["record"]["sources"])


def test_licence_of_three_readings(spark):
    rows = [(1, "DL I1234568\nEXP 08/31/2014", "DOB 08311977\nISS 08/31/2009", "CLASS C\nLN SAMPLE\nFN IMA\n2570 24TH STREET\nANYTOWN CA 95818"), (2, None, None, None), (3, "california", "12/31/2020", "LICENSE\nCLASS: none")]
    df = spark.createDataFrame(rows, "id int, fields string, a string, row string")
    found = {r["id"]: r["record"] for r in identity.driver_licences(df, ["fields", "a", "row"]).collect()}
    f = found[1]["fields"]
    assert (f["license_number"], f["surname"], f["given_names"], f["address"], f["date_of_birth"], f["date_of_issue"], f["date_of_expiry"], f["categories"]) == ("I1234568", "SAMPLE", "IMA", "2570 24TH STREET", "08/31/1977", "08/31/2009", "08/31/2014", ["C"])
    assert found[2]["populated"] == 0 and found[2]["code"] == "identity_mapping_low_confidence"


def test_zone_readers(spark):
    t = F.col("t")
    rows = ["<USADOE<<JANE<ANN", "PPD<<MUSTER<<ERIKA\nC01X00T478D<<6408125F2702283", "P<FARSI<<AHMAD<AL", "P<MANSOURI<<LAYLA<AL", "", None, "nothing"]
    found = values(spark, zonetext.answer_fields(t, STATES), rows)
    assert [(x["surname"], x["given_names"], x["nationality"]) if x else x for x in found] == [("DOE", "JANE ANN", "UNITED STATES OF AMERICA"), ("MUSTER", "ERIKA", "GERMANY"), ("AL FARSI", "AHMAD AL", None), ("AL MANSOURI", "LAYLA AL", None), None, None, (None, None, None)]
    assert found[1]["document_number"] == "C01X00T47" and found[1]["date_of_birth"] == "12.08.1964"
    loose = values(spark, zonetext.zone_in_text(t, STATES), rows)
    assert [(x["surname"], x["given_names"]) if x else x for x in loose] == [None, ("MUSTER", "ERIKAC X T D"), ("AL FARSI", "AHMAD AL"), None, None, None, None]
    assert values(spark, zonetext.flat_passport(t, ("sex", "surname"), STATES), ["Surname: DOE\nno AB1234567\nsex: F", None, ""]) == [{"surname": "DOE", "sex": "F", "document_number": "AB1234567"}, None, {}]
    assert values(spark, zonetext.service_zone(t), [None, "", "x"]) == [None, None, None]


def test_gate_cases(spark):
    """Values are compared as they are spelled, cleaned and under their canonical keys; lists are allowed where the catalogue has one."""
    spelled = '{"surname":"AA","given_names":"aa","nationality":"BB","sex":"bb"}'
    cases = [("passport", spelled, "structured_adapter_mapping"), ("passport", '{"surname":"N/A","given_names":"N/A","sex":"x","mrz":"UNKNOWN"}', "structured_fields_too_sparse"), ("passport", '{"Last Name":"A","fore-name":"B","citizenship":"C"}', "structured_adapter_mapping")]
    cases += [("driver_license", '{"surname":"A","categories":["B","C"]}', "structured_adapter_mapping"), ("driver_license", '{"surname":["A"],"categories":["B","C"]}', "structured_fields_invalid"), ("invoice", '{"seller":{"name":"A","zip":"1"}}', "structured_fields_invalid"), ("invoice", '{"seller":{"name":"A"},"line_items":[{"quantity":2,"tax_rate":"7"}]}', "structured_adapter_mapping")]
    cases += [("other", '{"a":"1","b":"2","c":{"d":"3"}}', "structured_adapter_mapping"), ("passport", None, "structured_json_not_found"), (None, '{"a":"1"}', "structured_fields_too_sparse"), ("passport", '{"fields":[]}', "structured_fields_missing"), ("passport", "{}", "structured_fields_too_sparse")]
    df = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(cases)], "i int, kind string, t string").coalesce(1)
    assert [r["c"] for r in df.select(typed.structured_gate(F.col("kind"), F.col("t"))["code"].alias("c")).collect()] == [c for *_, c in cases]
    reason = df.where("i in (4, 5)").select(typed.typed_record(F.col("kind"), F.col("t"))["reason"].alias("r"))
    assert [r["r"] for r in reason.collect()] == ["surname: text", "seller: party"]


def every_tail(t):
    """The object that the least trimming leaves, by trying every trim."""
    start = t.find("{")
    raw = t[start:].strip() if start >= 0 else ""
    cut = raw.rfind("}")
    for attempt in ([raw[: cut + 1]] if cut >= 0 else []) + [raw]:
        cleaned = re.sub(r",(\s*[}\]])", r"\1", attempt.strip().strip("`"))
        for trim in range(1, min(len(cleaned), 200)):
            short = cleaned[:-trim].rstrip(", \n\r\t")
            short += "" if short.endswith("}") else "}" * (short.count("{") - short.count("}"))
            try:
                if isinstance(found := json.loads(short), dict):
                    return found
            except ValueError:
                pass
    return None


def test_trimmed_tails(spark):
    rng = random.Random(3)

    def value(depth):
        r = rng.random()
        if depth > 3 or r < 0.5:
            return rng.choice([1, -12.5e3, "a", "b{c", "x}y", True, None, "", ", ", 12345, "é\n"])
        return {rng.choice("kmzq"): value(depth + 1) for _ in range(rng.randrange(4))} if r < 0.8 else [value(depth + 1) for _ in range(rng.randrange(3))]

    rows = [None, "", "{", "x", '{"a": 1}}']
    for _ in range(1500):
        t = json.dumps({f"k{i}": value(0) for i in range(rng.randrange(4))}, indent=rng.choice([None, 1]))
        t = t[: rng.randrange(len(t) + 1)]
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(t) + 1)
            t = t[:i] + rng.choice(['"', ",", "}", "{", "]", "[", " ", "x", ":", "1", "`"]) + t[i:]
        rows.append(t)
    found = [None if x is None else json.loads(x) for x in values(spark, jsonops.trimmed(F.col("t")), rows)]
    assert found == [None if t is None else every_tail(t) for t in rows]
    assert values(spark, jsonops.object_text(F.col("t")), ['{"a": 1}}', '{"a": 1} x}', '{"a": 1},{"b": 2}', '{"a": 1}']) == [None, None, None, '{"a": 1}']


def digit(s):
    value = lambda c: 0 if c == "<" else int(c) if c.isdigit() else ord(c.upper()) - 55
    return str(sum(value(c) * (7, 3, 1)[i % 3] for i, c in enumerate(s)) % 10)


def test_check_digits(spark):
    rng = random.Random(1)
    rows = ["", "<", "a", "A b", "é~!", *("".join(rng.choices("<0123456789ABCXYZmz", k=rng.randrange(45))) for _ in range(300)), None]
    assert values(spark, mrz.check_digit(F.col("t")), rows) == [None if r is None else digit(r) for r in rows]


@pytest.mark.parametrize("confusions", [mrz.CONFUSIONS, mrz.MORE_CONFUSIONS])
def test_repairs(spark, confusions):
    """One and two substitutions against trying all, by both tables."""
    rng = random.Random(5)
    good = lambda x: digit(x[:9]) == x[9] and digit(x[13:19]) == x[19] and digit(x[21:27]) == x[27] and digit(x[:10] + x[13:20] + x[21:43]) == x[43]
    single = lambda x: [x[:i] + a + x[i + 1 :] for i, c in enumerate(x) for a in confusions.get(c, "")]

    def line():
        doc, birth, expiry, more = "".join(rng.choices("ABCEIOPS0123456789", k=9)), "".join(rng.choices("0123456789", k=6)), "".join(rng.choices("0123456789", k=6)), "".join(rng.choices("0123456789<", k=14))
        head = doc + digit(doc) + "UTO" + birth + digit(birth) + "F" + expiry + digit(expiry) + more + "0"
        return head + digit(head[:10] + head[13:20] + head[21:43])

    rows = [line() for _ in range(12)]
    rows += [rng.choice(single(x)) for x in rows] + [rng.choice(single(rng.choice(single(x)))) for x in rows] + ["", "short", "X" * 60]
    found = {r["i"]: (r["fixed"], r["n_edits"]) for r in mrz.repair_pairs(spark.createDataFrame(list(enumerate(rows)), "i int, l2 string"), "l2", "i", confusions).collect()}
    for i, x in enumerate(rows):
        x = (x.upper() + "<" * 44)[:44]
        want = (x, 0) if good(x) else next(((y, 1) for y in single(x) if good(y)), None) or next(((z, sum(a != b for a, b in zip(x, z))) for y in single(x) for z in single(y) if good(z)), (x, -1))
        assert found[i] == want, x


def test_invoices(spark):
    cases = {"<s_seller>Shop</s_seller>": ("Shop", None), "1234567 EUR 1.234,50 99,00": (None, "$ 1.234,50"), "": (None, None)}
    found = values(spark, invoice.schema(F.col("t")), [*cases, None])
    assert [x and (x["seller"], x["total_net_worth"]) for x in found] == [*cases.values(), None]
    flat = {"invoice_no": "1", "iban": None, "total_vat": 3, "item_qty": "2", "color": "red"}
    whole = [json.dumps(flat), '{"header": {"a": 1}, "items": [{"b": 2}], "total_vat": "x"}', "{}", None]
    assert [x and json.loads(x) for x in values(spark, invoice.simplified(F.col("t"), True), whole)] == [{"header": {"invoice_no": "1", "iban": None}, "items": [{"item_qty": "2"}], "summary": {"total_vat": 3}}, {"header": {"a": 1}, "items": [{"b": 2}], "summary": {"total_vat": "x"}}, {}, None]
    assert values(spark, invoice.truth(F.col("t")), ['{"header": {"invoice_no": "7"}, "summary": {"total_vat": "1"}}'])[0]["total_vat"] == "1"


def test_accents(spark):
    assert values(spark, text.without_accents(F.col("t")), ["Šimić", "Żak  ő", "ẤẾ", "ó", "ł’", None]) == ["SIMIC", "ZAK O", "AE", "O", "Ł’", None]
