"""Queries of typed records, mended JSON, invoices and targets, each with the same result as SQL that works on the derived text."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import invoice, jsonops, payload, typed
from scriptorium.operators.rows import bound
from scriptorium.plans.fixtures import derive
from scriptorium.plans.queries import query

#: Answers of a model over customers: objects under "fields" or bare, spelled keys, sentinels, nested and repeated values, broken text; the record type varies too.
ANSWERS = """
SELECT c_custkey AS id, substr('passport      id_card       driver_licenseinvoice       other         ', CAST(c_custkey % 5 AS INT) * 14 + 1, 14) AS kind_,
  concat(CASE c_custkey % 17 WHEN 0 THEN 'no object' WHEN 1 THEN 'answer: ' ELSE '' END, CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 19 = 0 THEN '{"fields": [1]}' WHEN c_custkey % 19 = 1 THEN '{"fields": null, "Surname": "x"}' ELSE concat(
    CASE WHEN c_custkey % 2 = 0 THEN '{"document_type": "p", "fields": ' ELSE '' END, '{', concat_ws(', ',
      CASE WHEN c_custkey % 3 < 2 THEN concat('"Last Name": "', CASE WHEN c_custkey % 7 = 0 THEN 'N/A' WHEN c_custkey % 7 = 1 THEN 'xxx' ELSE c_mktsegment END, '"') END, CASE WHEN c_custkey % 4 < 3 THEN concat('"first_name": "', CASE WHEN c_custkey % 11 < 4 THEN c_mktsegment WHEN c_custkey % 11 < 6 THEN lower(c_mktsegment) ELSE c_name END, '"') END,
      CASE c_custkey % 6 WHEN 0 THEN concat('"DL No": "no AB', lpad(CAST(c_custkey AS STRING), 6, '0'), ' x"') WHEN 1 THEN concat('"document_number": ', CAST(c_custkey + 1000000 AS STRING)) WHEN 2 THEN '"document_number": null' WHEN 3 THEN concat('"invoice_no": "', CAST(c_custkey AS STRING), '"') END,
      CASE c_custkey % 8 WHEN 0 THEN '"class": "A, B1 x A"' WHEN 1 THEN '"categories": ["B", " ", "C"]' WHEN 2 THEN '"categories": [["B"]]' WHEN 3 THEN '"class": "none"' WHEN 4 THEN '"nationality": true' WHEN 5 THEN '"nationality": ["X", "Y"]' WHEN 6 THEN '"nationality": {}' END,
      CASE c_custkey % 9 WHEN 0 THEN '"seller": {"name": "Shop", "iban": "___", "address": "Road"}' WHEN 1 THEN '"seller": {"name": "Shop", "color": "red"}' WHEN 2 THEN '"seller": "Shop"' WHEN 3 THEN '"line_items": [{"description": "Pen", "quantity": 2}, {"unit_price": ""}, {"tax_rate": "7"}]' WHEN 4 THEN '"line_items": ["Pen"]' WHEN 5 THEN '"address": "01/02/2003"' WHEN 6 THEN '"extracted_pairs": {"a": "1", "b": {"c": "2"}, "d": " "}' WHEN 7 THEN '"extracted_pairs": "none"' END,
      CASE WHEN c_custkey % 10 < 4 THEN concat('"exp": "', c_mktsegment, '"') WHEN c_custkey % 10 = 4 THEN '"expiry_date": "01/02/2030"' END, CASE WHEN c_custkey % 13 < 5 THEN concat('"dob": "', c_mktsegment, '"') END, CASE WHEN c_custkey % 13 = 6 THEN '"issue date": "UNKNOWN", "Document Date": "05/06/2019"' END),
    CASE WHEN c_custkey % 12 = 5 THEN ',' ELSE '' END, '}', CASE WHEN c_custkey % 2 = 0 AND c_custkey % 14 <> 4 THEN '}' ELSE '' END) END) AS t FROM customer"""

_SPELLED = {s: k for kind in (None,) for k, many in payload.COMMON.items() for s in many}
_ALL = {f"{kind} {s}": payload.COMMON and next((k for k, many in payload.COMMON.items() if s in many), None) or k for kind, table in payload.TYPED.items() for k, many in table.items() for s in many}
_SHAPES = {f"{kind} {f}": shape for kind, fields in typed.CATALOGUE.items() for f, shape in fields.items()}


def _map(m: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in m.items()) + "}"


def _clean(c: str) -> str:
    return f"CASE WHEN trim({c}) IN ('', '___', '__', '_', 'N/A', 'NULL', 'UNKNOWN', 'None') OR regexp_full_match(trim({c}), '_+') OR (length(trim({c})) > 2 AND length(replace(trim({c}), substr(trim({c}), 1, 1), '')) = 0) THEN NULL ELSE trim({c}) END"


_KINDS = "AM|A1|A2|A|B1|B|C1|C|D1|D|BE|CE|DE|T"
_PLAIN = "CASE WHEN json_type({v}) = 'BOOLEAN' THEN CASE WHEN json_extract_string({v}, '$') = 'true' THEN 'True' ELSE 'False' END ELSE json_extract_string({v}, '$') END"


def _typed_ctes() -> str:
    """CTEs from t (id, kind, found: JSON object or null) to j (id, k, shape, fits, parts, nested): cells of records, one row a field."""
    moves = " ".join(f"WHEN kind = '{kind}' AND k = '{a}' AND NOT list_contains(ks, '{b}') THEN '{b}'" for kind, pairs in payload.MOVES["service"].items() for a, b in pairs if a != "document_date")
    # a document's date comes after the others
    late = " ".join(f"WHEN kind = '{kind}' AND k = 'document_date' AND NOT list_contains(ks, 'date_of_issue') THEN 'date_of_issue'" for kind in payload.MOVES["service"])
    token = lambda n: rf"coalesce(nullif(regexp_extract(v, '\b[A-Z0-9]{{{n},10}}\b'), ''), v)"
    kinds = rf"list_sort(list_distinct(regexp_extract_all(upper(v), '\b(?:{_KINDS})\b')))"
    item = _clean(_PLAIN.format(v="x"))
    members = lambda j: f"[{{'k': m, 'v': json_extract({j}, concat('$.\"', m, '\"'))}} for m in json_keys({j})]"
    scalar = lambda j: f"(json_type({j}) NOT IN ('OBJECT', 'ARRAY'))"
    kept = lambda j: f"[x for x in {members(j)} if {scalar('x.v')} = false OR {_clean(_PLAIN.format(v='x.v'))} IS NOT NULL]"
    flat = lambda j, keys: f"(json_type({j}) = 'OBJECT' AND len([x for x in {kept(j)} if NOT {scalar('x.v')} OR x.k NOT IN {keys}]) = 0)"
    elements = "CAST(json_extract(js, '$[*]') AS JSON[])"
    said = lambda j: f"[{_clean(_PLAIN.format(v='y.v'))} for y in {kept(j)}]"
    return rf"""p AS (SELECT id, kind, unnest(json_keys(found)) AS raw, generate_subscripts(json_keys(found), 1) AS n, found FROM t WHERE found IS NOT NULL),
q AS (SELECT *, json_extract(found, concat('$."', raw, '"')) AS js, regexp_replace(lower(raw), '[^a-z0-9]+', '', 'g') AS sq FROM p),
k0 AS (SELECT id, kind, coalesce({_map(_SPELLED)}[sq], {_map(_ALL)}[concat(kind, ' ', sq)], raw) AS k, n, js, json_type(js) IN ('OBJECT', 'ARRAY') AS nested, {_clean(_PLAIN.format(v='js'))} AS v FROM q),
k1 AS (SELECT * FROM k0 QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY n DESC) = 1), k2 AS (SELECT *, list(k) OVER (PARTITION BY id) AS ks FROM k1 WHERE nested OR v IS NOT NULL),
k3 AS (SELECT * REPLACE (CASE {moves} ELSE k END AS k) FROM k2), k4 AS (SELECT * REPLACE (list(k) OVER (PARTITION BY id) AS ks) FROM k3), k5 AS (SELECT * REPLACE (CASE {late} ELSE k END AS k) FROM k4),
r AS (SELECT id, kind, k, js, nested, CASE WHEN nested THEN v WHEN kind = 'driver_license' AND k = 'license_number' THEN {token(7)} WHEN kind = 'passport' AND k = 'document_number' THEN {token(8)} WHEN kind = 'driver_license' AND k IN ('address', 'issuing_authority') AND regexp_full_match(v, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN NULL
  WHEN kind = 'driver_license' AND k = 'categories' THEN (SELECT array_to_string(list(w ORDER BY i), ',') FROM (SELECT w, min(i) AS i FROM (SELECT unnest(regexp_extract_all(upper(v), '\b(?:{_KINDS})\b')) AS w, generate_subscripts(regexp_extract_all(upper(v), '\b(?:{_KINDS})\b'), 1) AS i) GROUP BY w)) ELSE v END AS v FROM k5),
s AS (SELECT id, kind, k, js, nested, v, {_map(_SHAPES)}[concat(kind, ' ', k)] AS shape, count(*) FILTER (WHERE k = 'extracted_pairs') OVER (PARTITION BY id) AS paired FROM r WHERE nested OR v IS NOT NULL),
u AS (SELECT id, kind, k, js, nested, v, CASE WHEN kind = 'other' THEN CASE WHEN k = 'extracted_pairs' AND json_type(js) <> 'OBJECT' THEN 'object' ELSE 'pair' END ELSE shape END AS shape FROM s WHERE (kind <> 'other' AND shape IS NOT NULL) OR (kind = 'other' AND (paired = 0 OR (k = 'extracted_pairs' AND json_type(js) <> 'OBJECT')))
  UNION ALL SELECT id, kind, x.k, x.v, NOT {scalar('x.v')}, {_clean(_PLAIN.format(v='x.v'))}, 'pair' FROM (SELECT id, kind, unnest({kept('js')}) AS x FROM s WHERE kind = 'other' AND k = 'extracted_pairs' AND json_type(js) = 'OBJECT')),
j AS (SELECT id, kind, k, shape, nested OR shape = 'texts' AS nested, CASE shape WHEN 'pair' THEN true WHEN 'object' THEN false WHEN 'text' THEN NOT nested WHEN 'texts' THEN NOT nested OR (json_type(js) = 'ARRAY' AND len([x for x in {elements} if NOT {scalar('x')} AND CAST(x AS VARCHAR) NOT IN ('{{}}', '[]')]) = 0)
    WHEN 'party' THEN nested AND {flat('js', typed.PARTY)} ELSE nested AND json_type(js) = 'ARRAY' AND len([x for x in {elements} if (NOT {scalar('x')} AND CAST(x AS VARCHAR) NOT IN ('{{}}', '[]') AND NOT {flat('x', typed.ITEM)}) OR ({scalar('x')} AND {item} IS NOT NULL)]) = 0 END AS fits,
  CASE WHEN NOT nested THEN CASE WHEN shape = 'texts' THEN string_split(v, ',') ELSE [v] END WHEN shape = 'items' THEN flatten([{said('x')} for x in {elements} if NOT {scalar('x')}]) WHEN json_type(js) = 'ARRAY' THEN [y for y in [CASE WHEN {scalar('x')} THEN {item} ELSE nullif(nullif(CAST(x AS VARCHAR), '{{}}'), '[]') END for x in {elements}] if y IS NOT NULL] ELSE [CASE WHEN {scalar('y.v')} THEN {_clean(_PLAIN.format(v='y.v'))} ELSE CAST(y.v AS VARCHAR) END for y in {kept('js')}] END AS parts FROM u)"""


#: The object in a text: from the first brace to the last, without trailing commas; else to the end, with the missing braces.
def _object(t: str) -> str:
    raw = f"substr({t}, instr({t}, '{{'))"
    cut = f"substr({raw}, 1, length({raw}) - instr(reverse({raw}), '}}') + 1)"
    clean = lambda x: rf"regexp_replace({x}, ',\s*([}}\]])', '\1', 'g')"
    closed = lambda x: rf"concat(regexp_replace({x}, ',\s*$', ''), repeat('}}', greatest(0, length(regexp_replace({x}, '[^{{]', '', 'g')) - length(regexp_replace({x}, '[^}}]', '', 'g')))))"
    good = lambda x: rf"CASE WHEN json_valid({x}) AND NOT regexp_matches({x}, ',\s*[}}\]]') THEN {x} END"
    return f"CASE WHEN instr({t}, '{{') > 0 THEN coalesce({', '.join(good(y) for x in (cut, raw) for y in (x, clean(x), clean(closed(x))))}) END"


_FOUND = f"""src AS (SELECT id, trim(kind_) AS kind, t FROM ({ANSWERS})), o AS (SELECT id, kind, CAST({_object('t')} AS JSON) AS obj FROM src),
i AS (SELECT *, CASE WHEN list_contains(json_keys(obj), 'fields') THEN json_extract(obj, '$.fields') ELSE obj END AS inner_ FROM o), t AS (SELECT id, kind, obj, inner_, CASE WHEN json_type(inner_) = 'OBJECT' THEN inner_ END AS found FROM i)"""


@query(f"""WITH {_FOUND}, {_typed_ctes()},
v AS (SELECT id, bool_and(fits) AS good, CAST(sum(len([x for x in parts if trim(x) <> ''])) AS INT) AS n FROM j GROUP BY id),
w AS (SELECT id, unnest(CASE WHEN NOT nested OR shape = 'party' THEN parts WHEN len(parts) > 0 THEN [CAST(to_json(parts) AS VARCHAR)] ELSE [] END) AS x FROM j), y AS (SELECT id, count(*) AS total, count(DISTINCT trim(x)) AS distinct_ FROM w WHERE trim(x) <> '' GROUP BY id),
c AS (SELECT t.id AS id, CASE WHEN obj IS NULL THEN 'structured_json_not_found' WHEN found IS NULL THEN 'structured_fields_missing' WHEN NOT coalesce(good, true) THEN 'structured_fields_invalid' WHEN coalesce(total >= 4 AND distinct_ <= greatest(2, total // 2), false) THEN 'structured_fields_repetitive' WHEN coalesce(n, 0) < 3 THEN 'structured_fields_too_sparse' ELSE 'structured_adapter_mapping' END AS code FROM t LEFT JOIN v ON v.id = t.id LEFT JOIN y ON y.id = t.id)
SELECT id, code, CASE WHEN code = 'structured_adapter_mapping' THEN 'info' ELSE 'warning' END AS severity, code = 'structured_adapter_mapping' AS is_valid FROM c""")
def structured_gate(spark, sf_dir):
    a = derive(spark, sf_dir, ANSWERS)
    return a.select("id", typed.structured_gate(F.trim("kind_"), F.col("t")).alias("g")).select("id", "g.*")


@query(f"""WITH {_FOUND}, {_typed_ctes()}, x AS (SELECT id, bool_and(fits) AS good FROM j GROUP BY id)
SELECT j.id AS id, k AS key, shape, CASE WHEN nested THEN NULL ELSE parts[1] END AS value, CASE WHEN nested THEN CAST(len(parts) AS INT) END AS n_parts FROM j JOIN x ON x.id = j.id WHERE good""")
def typed_records(spark, sf_dir):
    """Fields of all answers that fit their catalogue."""
    a = derive(spark, sf_dir, ANSWERS).select("id", F.trim("kind_").alias("kind"), jsonops.object_text(F.col("t")).alias("o"))
    inner = F.when(F.array_contains(F.json_object_keys("o"), "fields"), F.get_json_object("o", "$.fields")).otherwise(F.col("o"))
    r = bound(a.select("id", "kind", inner.alias("inner_")), r=typed.typed_record(F.col("kind"), F.col("inner_"))).where("r.reason is null")
    each = r.select("id", "r", F.explode(F.map_entries("r.shapes")).alias("e")).select("id", F.col("e.key").alias("key"), F.col("e.value").alias("shape"), "r")
    return each.select("id", "key", "shape", F.try_element_at("r.values", "key").alias("value"), F.size(F.try_element_at("r.lists", "key")).alias("n_parts")).withColumn("n_parts", F.when(F.col("n_parts") >= 0, F.col("n_parts")))


#: Objects whose ends are cut, overwritten or followed by other text, at places that depend on the event.
BROKEN = """SELECT event_id AS id, concat(CASE WHEN event_id % 5 = 0 THEN 'so: ' ELSE '' END, substr(whole, 1, CAST(length(whole) - event_id % 41 AS INT)), CASE event_id % 7 WHEN 0 THEN '}' WHEN 1 THEN '"' WHEN 2 THEN ', ' WHEN 3 THEN ' end}' WHEN 4 THEN ':' ELSE '' END) AS t
FROM (SELECT event_id, concat('{"type": "', event_type, '", "user": {"id": ', CAST(user_id AS STRING), ', "on": true}, "value": ', CAST(CAST(floor(value * 100) AS BIGINT) AS STRING), ', "props": ', props, ', "tags": ["a", "b"], "last": null, "end": "', event_type, '"}') AS whole FROM events)"""

# every tail is tried, with whatever braces its text lacks
_CUT = "CASE WHEN contains(raw, '}') THEN substr(raw, 1, length(raw) - instr(reverse(raw), '}') + 1) END"


@query(rf"""WITH b AS ({BROKEN}), d AS (SELECT id, {_object('t')} AS found, CASE WHEN instr(t, '{{') > 0 THEN trim(substr(t, instr(t, '{{'))) END AS raw FROM b),
a AS (SELECT id, 1 AS attempt, {_CUT} AS c FROM d WHERE found IS NULL UNION ALL SELECT id, 2, raw FROM d WHERE found IS NULL), e AS (SELECT id, attempt, regexp_replace(trim(c, ' `'), ',(\s*[}}\]])', '\1', 'g') AS c FROM a WHERE c IS NOT NULL),
s AS (SELECT id, attempt, trim_, rtrim(substr(c, 1, CAST(length(c) - trim_ AS INT)), ', ' || chr(10) || chr(13) || chr(9)) AS x FROM e, range(1, 200) r(trim_) WHERE trim_ < length(c)),
g AS (SELECT id, attempt, trim_, CASE WHEN ends_with(x, '}}') THEN x ELSE concat(x, repeat('}}', greatest(0, length(regexp_replace(x, '[^{{]', '', 'g')) - length(regexp_replace(x, '[^}}]', '', 'g'))))) END AS x FROM s),
h AS (SELECT id, arg_min(x, attempt * 1000 + trim_) AS x FROM g WHERE json_valid(x) AND starts_with(x, '{{') AND NOT regexp_matches(x, ',\s*[}}\]]') GROUP BY id)
SELECT d.id AS id, coalesce(d.found, h.x) AS object, d.found IS NULL AND h.x IS NOT NULL AS trimmed FROM d LEFT JOIN h ON h.id = d.id""")
def trimmed_objects(spark, sf_dir):
    b = derive(spark, sf_dir, BROKEN, ("events",)).select("id", F.col("t"), jsonops.object_text(F.col("t")).alias("found"))
    b = b.select("id", "found", jsonops.trimmed(F.when(F.col("found").isNull(), F.col("t"))).alias("cut"))
    return b.select("id", F.coalesce("found", "cut").alias("object"), F.col("cut").isNotNull().alias("trimmed"))


#: Invoice text of order lines: with tags, without any, with few.
INVOICES = """SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_partkey % 6 = 0 THEN concat('<s><s_invoice_no> ', CAST(l_orderkey AS STRING), ' </s_invoice_no><s_iban></s_iban></s>', CASE WHEN l_suppkey % 2 = 0 THEN '<s_seller>Shop</s_seller>' ELSE '<s_seller>Shop' END) ELSE
  concat_ws(' ', CASE WHEN l_partkey % 5 < 2 THEN CAST(l_orderkey + 100000 AS STRING) END, CASE WHEN l_partkey % 4 = 1 THEN '<s_Name>Shop</s_Name>' WHEN l_partkey % 4 = 2 THEN '<s_Name></s_Name><s_Stadt>Town </s_Stadt>' END, CASE WHEN l_suppkey % 3 = 0 THEN '<s_Geburtsdatum>01 02 74</s_Geburtsdatum>' WHEN l_suppkey % 3 = 1 THEN '<s_Geburtsdatum>1.2.74</s_Geburtsdatum>' END,
    CASE WHEN l_suppkey % 7 < 3 THEN concat('tax ', lpad(CAST(l_suppkey % 1000 AS STRING), 3, '0'), '-12-', lpad(CAST(l_partkey % 10000 AS STRING), 4, '0')) END, CASE WHEN l_suppkey % 7 = 1 THEN '987-65-4321' END, CASE WHEN l_partkey % 11 < 4 THEN concat('IBAN DE89', lpad(CAST(l_partkey AS STRING), 14, '3')) END,
    CASE WHEN l_partkey % 8 = 3 THEN '<s_Gesetzl. Netto>12,5</s_Gesetzl. Netto>' WHEN l_partkey % 8 = 4 THEN '<s_Gesetzl. Netto>9.999,50 EUR</s_Gesetzl. Netto>' END, CASE WHEN l_suppkey % 5 < 3 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '.', lpad(CAST(l_partkey % 1000 AS STRING), 3, '0'), ',', lpad(CAST(l_suppkey % 100 AS STRING), 2, '0'), ' EUR') END, CASE WHEN l_suppkey % 5 = 1 THEN '7,25 8,5' END, CASE WHEN l_suppkey % 13 = 1 THEN '<s_Gesamtbrutto>1.000,00</s_Gesamtbrutto>' END) END AS t FROM lineitem"""


def _tag(c: str, name: str) -> str:
    rest = f"substr({c}, strpos({c}, '<s_{name}>') + {len(name) + 4})"
    return f"CASE WHEN strpos({c}, '<s_{name}>') > 0 AND strpos({rest}, '</s_{name}>') > 0 THEN trim(substr({rest}, 1, strpos({rest}, '</s_{name}>') - 1)) END"


_AMOUNT = "[0-9]{1,3}(?:\\.[0-9]{3})*,[0-9]{2}|[0-9]+,[0-9]{2}"


def _invoice_sql() -> str:
    amount = lambda c: f"CASE WHEN regexp_matches({c}, '{_AMOUNT}') THEN concat('$ ', regexp_extract({c}, '{_AMOUNT}')) END"
    groups = f"regexp_extract_all({_tag('c', 'Geburtsdatum')}, '[0-9]{{2,4}}')"
    fallback = {
        "invoice_no": r"nullif(regexp_extract(c, '\b[0-9]{6,10}\b'), '')", "invoice_date": f"CASE WHEN len({groups}) >= 3 THEN concat({groups}[1], '/', {groups}[2], '/', CASE WHEN length({groups}[3]) = 2 THEN '20' ELSE '' END, {groups}[3]) END",
        "seller": f"nullif(concat_ws(' ', nullif({_tag('c', 'Name')}, ''), nullif({_tag('c', 'Straße')}, ''), nullif({_tag('c', 'Stadt')}, '')), '')", "client": "NULL", "seller_tax_id": r"regexp_extract_all(c, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')[1]", "client_tax_id": r"regexp_extract_all(c, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')[2]",
        "iban": r"nullif(regexp_extract(c, '\b[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\b'), '')", "total_net_worth": amount(f"coalesce(nullif({_tag('c', 'Gesetzl. Netto')}, ''), regexp_extract_all(c, '{_AMOUNT}')[1])"), "total_vat": "NULL", "total_gross_worth": amount(f"coalesce(nullif({_tag('c', 'Gesamtbrutto')}, ''), regexp_extract_all(c, '{_AMOUNT}')[2])"),
    }
    tags = ", ".join(f"{_tag('c', f)} AS t_{f}" for f in invoice.FIELDS)
    any_tag = f"coalesce({', '.join(f't_{f}' for f in invoice.FIELDS)}) IS NOT NULL"
    return f"WITH a AS (SELECT id, n, trim(replace(replace(replace(replace(t, '<pad>', ''), '</s>', ''), '<s>', ''), '<unk>', '')) AS c FROM ({INVOICES})), b AS (SELECT *, {tags} FROM a) SELECT id, n, " + ", ".join(f"CASE WHEN {any_tag} THEN t_{f} ELSE CAST({fallback[f]} AS VARCHAR) END AS {f}" for f in invoice.FIELDS) + " FROM b"


@query(_invoice_sql())
def invoice_fallbacks(spark, sf_dir):
    return derive(spark, sf_dir, INVOICES).select("id", "n", invoice.schema(F.col("t")).alias("s")).select("id", "n", "s.*")
