"""Typed records: a catalogue of record types, strict shredding of open JSON objects into their fields, and the gate over model answers.

An object is read as a map of VARIANT, its keys are mapped and its values cleaned (payload.normalize), and each known field must
have the shape that the catalogue gives it: text, a list of texts, one flat object with known keys, or a list of such objects.
The first field that hasn't rejects the whole record, with its name and shape; unknown keys are left aside. Types without
fields of their own keep all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import jsonops, payload, text
from scriptorium.functions.mrz import let

#: Fields of the record types and their shapes (fixed values).
PARTY = ("name", "address", "tax_id", "iban")
ITEM = ("description", "quantity", "unit_price", "total_price", "tax_rate")
CATALOGUE = {
    "invoice": {"invoice_no": "text", "invoice_date": "text", "due_date": "text", "currency": "text", "seller": "party", "buyer": "party", "line_items": "items", "total_net": "text", "total_tax": "text", "total_gross": "text"},
    "passport": dict.fromkeys(("document_number", "surname", "given_names", "nationality", "date_of_birth", "sex", "place_of_birth", "date_of_issue", "date_of_expiry", "issuing_authority", "mrz"), "text"),
    "id_card": dict.fromkeys(("document_number", "surname", "given_names", "nationality", "date_of_birth", "sex", "address", "personal_number", "date_of_issue", "date_of_expiry", "issuing_authority"), "text"),
    "driver_license": dict.fromkeys(("license_number", "surname", "given_names", "date_of_birth", "place_of_birth", "address", "date_of_issue", "date_of_expiry", "issuing_authority"), "text") | {"categories": "texts"},
}
#: What a type without fields of its own keeps its pairs in (fixed value).
PAIRS = "extracted_pairs"
#: Codes of the structured gate and their severity, in the order in which they are tried (fixed values).
CODES = {
    "structured_json_not_found": "warning", "structured_fields_missing": "warning", "structured_fields_invalid": "warning",
    "structured_fields_repetitive": "warning", "structured_fields_too_sparse": "warning", "structured_adapter_mapping": "info",
}
#: Stands before the JSON text of a nested value among texts.
_MARK = payload.NESTED


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _plain(v: Column) -> Column:
    """Text of a scalar VARIANT: booleans in capitals, null for null."""
    said = F.try_variant_get(v, "$", "string")
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(said)).otherwise(said)


def _is_nested(v: Column) -> Column:
    return _true(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"))


def shredded(json: Column) -> Column:
    """Map of an object's keys to texts; nested values are marked JSON text. Null if the text is no object."""
    pairs = F.map_entries(F.from_json(json, "map<string, variant>"))
    entries = F.transform(pairs, lambda e: F.struct(e["key"].alias("key"), F.when(_is_nested(e["value"]), F.concat(F.lit(_MARK), F.to_json(e["value"]))).otherwise(_plain(e["value"])).alias("value")))

    def last(es: Column) -> Column:
        keys = F.array_distinct(F.transform(es, lambda e: e["key"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(es, lambda e: e["key"] == k), -1)["value"]))

    is_object = F.schema_of_variant(F.try_parse_json(json)).startswith("OBJECT")
    return F.when(_true(is_object), let(entries, last))


def _inside(value: Column) -> Column:
    """JSON text of a marked value."""
    return F.when(value.startswith(_MARK), F.substr(value, F.lit(len(_MARK) + 1)))


def _items(value: Column) -> Column:
    """(nested, said) of a marked list: cleaned scalars, and its objects and lists as JSON text; empty ones dropped. Null if it is no list."""
    json = _inside(value)
    each = F.transform(F.from_json(F.when(json.startswith("["), json), "array<variant>"), lambda v: F.struct(_is_nested(v).alias("nested"), F.when(_is_nested(v), F.nullif(F.nullif(F.to_json(v), F.lit("{}")), F.lit("[]"))).otherwise(text.sanitized(_plain(v))).alias("said")))
    return F.filter(each, lambda x: x["said"].isNotNull())


def _members(json: Column) -> Column:
    """(key, nested, said) of an object's cleaned members; empty ones dropped. Null if it is no object."""
    each = F.transform(F.map_entries(F.from_json(F.when(json.startswith("{"), json), "map<string, variant>")), lambda e: F.struct(e["key"].alias("key"), _is_nested(e["value"]).alias("nested"), F.when(_is_nested(e["value"]), F.to_json(e["value"])).otherwise(text.sanitized(_plain(e["value"]))).alias("said")))
    return F.filter(each, lambda x: x["said"].isNotNull())


def _flat_object(json: Column, keys: tuple[str, ...]) -> Column:
    """Whether all members are texts with known keys; false for anything else."""
    return _true(F.forall(_members(json), lambda m: ~m["nested"] & m["key"].isin(*keys)))


def projection(kind: Column, fields: Column) -> Column:
    """(values, lists, reason): the typed record of a map from payload.normalize over shredded() values.

    values has texts by field, lists the parts of other fields (of an object its texts, of a list of objects the texts of all); reason is
    `field: shape` of the first field that doesn't fit (values and lists are then null), or null.
    """
    shapes = F.create_map(*(F.lit(x) for k, fs in CATALOGUE.items() for f, shape in fs.items() for x in (f"{k} {f}", shape)))
    known = kind.isin(*CATALOGUE)

    def own(m: Column) -> Column:
        pairs = F.try_element_at(m, F.lit(PAIRS))
        shape = F.when(known, F.try_element_at(shapes, F.concat(kind, F.lit(" ")))).otherwise(None)
        each = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.coalesce(F.try_element_at(shapes, F.concat(kind, F.lit(" "), e["key"])), shape).alias("shape")))
        typed = F.filter(each, lambda x: x["shape"].isNotNull())
        inner = F.transform(_members(_inside(pairs)), lambda x: F.struct(x["key"].alias("key"), F.when(x["nested"], F.concat(F.lit(_MARK), x["said"])).otherwise(x["said"]).alias("value"), F.lit("pair").alias("shape")))
        loose = F.when(pairs.isNull(), F.transform(each, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"), F.lit("pair").alias("shape")))).otherwise(F.coalesce(inner, F.array(F.struct(F.lit(PAIRS).alias("key"), pairs.alias("value"), F.lit("object").alias("shape")))))
        return F.when(known, typed).otherwise(loose)

    def judged(x: Column) -> Column:
        nested, json, items = x["value"].startswith(_MARK), _inside(x["value"]), _items(x["value"])
        fits = (
            F.when(x["shape"] == "pair", True).when(x["shape"] == "object", False).when(x["shape"] == "text", ~nested)
            .when(x["shape"] == "texts", ~nested | _true(F.forall(items, lambda i: ~i["nested"])))
            .when(x["shape"] == "party", _flat_object(json, PARTY)).otherwise(_true(F.forall(items, lambda i: i["nested"] & _flat_object(i["said"], ITEM))))
        )
        said = lambda ms: F.transform(ms, lambda m: m["said"])
        parts = F.when(~nested, F.when(x["shape"] == "texts", F.split(x["value"], ",")).otherwise(F.array(x["value"]))).when(x["shape"] == "items", F.flatten(F.transform(items, lambda i: said(_members(i["said"]))))).when(json.startswith("["), said(items)).otherwise(said(_members(json)))
        return F.struct(x["key"].alias("key"), x["shape"].alias("shape"), _true(fits).alias("fits"), (nested | (x["shape"] == "texts")).alias("nested"), F.coalesce(parts, F.array().cast("array<string>")).alias("parts"))

    def result(js: Column) -> Column:
        bad = F.get(F.filter(js, lambda j: ~j["fits"]), F.lit(0))
        good = bad.isNull()
        values = F.map_from_entries(F.transform(F.filter(js, lambda j: ~j["nested"]), lambda j: F.struct(j["key"], F.get(j["parts"], F.lit(0)))))
        lists = F.map_from_entries(F.transform(F.filter(js, lambda j: j["nested"]), lambda j: F.struct(j["key"], j["parts"])))
        shapes_ = F.map_from_entries(F.transform(js, lambda j: F.struct(j["key"], j["shape"])))
        return F.struct(F.when(good, values).alias("values"), F.when(good, lists).alias("lists"), F.when(good, shapes_).alias("shapes"), F.when(~good, F.concat(bad["key"], F.lit(": "), bad["shape"])).alias("reason"))

    return F.when(fields.isNotNull(), let(let(fields, own), lambda xs: let(F.transform(xs, judged), result)))


def typed_record(kind: Column, json: Column) -> Column:
    """projection of a JSON object's text; null if it is no object."""
    return projection(kind, payload.normalize(kind, shredded(json)))


def populated(record: Column) -> Column:
    """Filled parts of a typed record."""
    lists = F.aggregate(F.map_values(record["lists"]), F.lit(0), lambda n, xs: n + F.size(F.filter(xs, lambda x: F.trim(x) != "")))
    return F.size(F.filter(F.map_values(record["values"]), lambda x: F.trim(x) != "")) + lists


def _said(record: Column) -> Column:
    """The values that may repeat each other: texts, each part of an object, a list as one."""
    texts = F.filter(F.transform(F.map_values(record["values"]), text.strip), lambda x: x != "")
    many = F.transform(F.map_entries(record["lists"]), lambda e: F.when(F.size(e["value"]) == 0, F.array().cast("array<string>")).when(F.try_element_at(record["shapes"], e["key"]) == "party", e["value"]).otherwise(F.array(F.to_json(e["value"]))))
    return F.concat(texts, F.flatten(many))


def structured_gate(kind: Column, answer: Column, least: int = 3) -> Column:
    """(code, severity, is_valid) of a model's answer: the first gate that its JSON object doesn't pass.

    The fields are those under "fields", or the object itself without that key; they become a typed record, which must have
    `least` filled parts and not repeat itself (as spelled).
    """

    def judged(found: Column) -> Column:
        inner = F.when(_true(F.array_contains(F.json_object_keys(found), "fields")), F.get_json_object(found, "$.fields")).otherwise(found)
        is_object = _true(text.strip(inner).startswith("{"))
        return let(typed_record(kind, F.when(is_object, inner)), lambda r: coded(found, is_object, r))

    def coded(found: Column, is_object: Column, r: Column) -> Column:
        failed = [found.isNull(), ~is_object, r["reason"].isNotNull(), _true(let(_said(r), text.repetitive)), populated(r) < least]
        code = F.lit([*CODES][-1])
        for test, name in reversed([*zip(failed, CODES, strict=False)]):
            code = F.when(test, name).otherwise(code)
        return let(code, lambda c: F.struct(c.alias("code"), F.when(c == [*CODES][-1], "info").otherwise("warning").alias("severity"), (c == [*CODES][-1]).alias("is_valid")))

    return let(jsonops.object_text(answer), judged)
