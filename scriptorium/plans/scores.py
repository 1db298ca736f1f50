"""Queries of scores over fields, documents and tagged answers, and of field maps, each with the same result as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import dates, display, invoice, mrz, passport, payload, targets, text, trees
from scriptorium.operators import jobs, metrics
from scriptorium.plans.fixtures import derive
from scriptorium.plans.queries import ZONES, _valid, query
from scriptorium.plans.queries import zones as person_zones

_TRUTH = """SELECT o_orderkey AS id, 'seller' AS key, CASE WHEN o_orderkey % 6 > 0 THEN concat('Foo ', CAST(o_orderkey % 50 AS STRING), ' Bar ', o_orderpriority) END AS truth FROM orders
UNION ALL SELECT o_orderkey, 'client', CASE WHEN o_orderkey % 3 > 0 THEN concat(o_orderstatus, ' und ', CAST(o_custkey AS STRING)) END FROM orders"""
_ANSWERS = f"SELECT engine, id, key, truth, CASE WHEN (id + n) % 7 = 0 THEN NULL WHEN (id + length(key) * n) % 4 = 0 THEN replace(truth, ' ', concat(' x', CAST(n AS STRING), ' ')) WHEN (id + n) % 5 = 0 THEN concat(truth, ' ', truth) ELSE truth END AS predicted FROM ({_TRUTH}) t CROSS JOIN (SELECT 'base' AS engine, 1 AS n UNION ALL SELECT 'tuned', 3) e"
_DICE = "CASE WHEN predicted IS NULL THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(list_distinct(string_split(predicted, ' ')), list_distinct(string_split(truth, ' ')))) / (len(list_distinct(string_split(predicted, ' '))) + len(list_distinct(string_split(truth, ' ')))) END"
_SCORED = f"c AS (SELECT engine, id, key, coalesce(predicted = truth, false) AS match, {_DICE} AS soft FROM ({_ANSWERS}) WHERE truth IS NOT NULL)"
_KEYS = ("seller", "client", "iban")


def _cells(spark, sf_dir):
    a = derive(spark, sf_dir, _ANSWERS).where("truth is not null")
    return a.select("engine", "id", "key", F.coalesce(F.col("predicted") == F.col("truth"), F.lit(False)).alias("match"), metrics.token_dice(F.col("predicted"), F.col("truth")).alias("soft"))


@query(f"""WITH {_SCORED}, k AS (SELECT * FROM (SELECT DISTINCT engine FROM c) CROSS JOIN (VALUES ('seller'), ('client'), ('iban')) v(key))
SELECT k.engine AS engine, k.key AS key, count(*) FILTER (WHERE match) AS correct, count(match) AS total, round(coalesce(avg(CASE WHEN match THEN 1.0::DOUBLE WHEN NOT match THEN 0.0 END), 0), 9) AS accuracy, round(coalesce(avg(soft), 0), 9) AS similarity FROM k LEFT JOIN c ON c.engine = k.engine AND c.key = k.key GROUP BY k.engine, k.key""")
def similarity_by_field(spark, sf_dir):
    found = metrics.by_field(_cells(spark, sf_dir), _KEYS)
    return found.withColumns({c: F.round(c, 9) for c in ("accuracy", "similarity")})


@query(f"""WITH {_SCORED}, a AS (SELECT DISTINCT engine, id FROM ({_ANSWERS})), d AS (SELECT engine, id, bool_and(match) AS exact, avg(soft) AS soft FROM c GROUP BY engine, id)
SELECT a.engine AS engine, count(*) AS n_documents, round(avg(CASE WHEN coalesce(exact, true) THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS exact, round(avg(coalesce(soft, 0)), 9) AS soft FROM a LEFT JOIN d ON d.engine = a.engine AND d.id = a.id GROUP BY a.engine""")
def similarity_by_document(spark, sf_dir):
    """Orders by 6 have no truth at all, and count."""
    documents = derive(spark, sf_dir, _ANSWERS).select("engine", "id")
    return metrics.by_document(_cells(spark, sf_dir), documents).withColumns({c: F.round(c, 9) for c in ("exact", "soft")})


#: Truths as JSON and tagged answers: whole, with a changed, a missing, a repeated and an additional field, without tags.
_TAGGED = """SELECT c_custkey AS id, concat('{"name": "', c_name, '", "to": {"segment": "', c_mktsegment, '", "nation": "', CAST(c_nationkey AS STRING), '"}}') AS truth,
CASE c_custkey % 7 WHEN 0 THEN c_name WHEN 6 THEN NULL ELSE concat('<s_name>', c_name, CASE WHEN c_custkey % 7 = 1 THEN 'x' ELSE '' END, '</s_name><s_to><s_segment>', c_mktsegment, '</s_segment>', CASE WHEN c_custkey % 7 = 2 THEN '' ELSE concat('<s_nation>', CAST(c_nationkey AS STRING), '</s_nation>') END, '</s_to>', CASE WHEN c_custkey % 7 = 3 THEN '<s_more>1</s_more>' ELSE '' END) END AS answer FROM customer"""


@query("SELECT c_custkey AS id, c_custkey % 7 IN (4, 5) AS exact, round(CASE c_custkey % 7 WHEN 0 THEN 0.0 WHEN 6 THEN 0.0 WHEN 1 THEN 2.0::DOUBLE / 3 WHEN 2 THEN 4.0::DOUBLE / 5 WHEN 3 THEN 6.0::DOUBLE / 7 ELSE 1.0 END, 9) AS field_f1 FROM customer")
def tagged_answers(spark, sf_dir):
    s = derive(spark, sf_dir, _TAGGED).select("id", trees.json_scores(F.col("truth"), F.col("answer")).alias("s"))
    return s.select("id", "s.exact", F.round("s.field_f1", 9).alias("field_f1"))


@query()
def tagged_similarity(spark, sf_dir):
    """The ratio of the canonical texts, which SQL can't express; the tests compute it anew."""
    return derive(spark, sf_dir, _TAGGED).select("id", trees.json_scores(F.col("truth"), F.col("answer"))["similarity"].alias("similarity"))


_DEEP = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN '{cut' WHEN 1 THEN 'null' WHEN 2 THEN '[]' ELSE concat('{"a": {"b": "', CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END, '", "c": [null, ', CAST(user_id AS STRING), ', {"d": false}]}, "p": ', CASE WHEN event_id % 5 = 0 THEN '{}' ELSE props END, ', "e": [', CASE WHEN event_id % 2 = 0 THEN '"", "x"' ELSE '' END, ']}') END AS t FROM events"""


@query("SELECT event_id, CAST(CASE WHEN event_id % 8 < 3 THEN 0 ELSE 2 + (CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END) + (CASE WHEN event_id % 5 = 0 OR json_extract_string(props, '$.k') IS NULL THEN 0 ELSE 1 END) + (CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) END AS BIGINT) AS n FROM events")
def populated_leaves(spark, sf_dir):
    return derive(spark, sf_dir, _DEEP).select("event_id", trees.populated_leaves("t").alias("n"))


_FIELDS = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_name END AS surname, CASE c_custkey % 3 WHEN 0 THEN '  ' ELSE concat(' ', c_mktsegment, '  x') END AS address, CASE WHEN c_custkey % 4 > 0 THEN concat('N-', CAST(c_custkey AS STRING)) END AS license_number, CASE c_custkey % 2 WHEN 0 THEN '01/01/2000' ELSE '' END AS date_of_issue, CASE c_custkey % 6 WHEN 0 THEN '' ELSE 'M' END AS sex, concat(CASE c_custkey % 7 WHEN 0 THEN 'PP_' WHEN 1 THEN 'Rp_' WHEN 2 THEN 'my_Passport' WHEN 3 THEN 'id_card' WHEN 4 THEN 'residence' WHEN 5 THEN 'x_idcard' ELSE 'bill' END, CAST(c_custkey % 9 AS STRING)) AS template FROM customer"
_FILLED = ("surname", "address", "license_number", "date_of_issue", "sex")
_PLACES = {k: payload.ENTITIES[k] for k in _FILLED if k in payload.ENTITIES}


def _field_map(spark, sf_dir):
    f = derive(spark, sf_dir, _FIELDS)
    return f.select("id", "template", F.create_map(*(x for c in _FILLED for x in (F.lit(c), F.col(c)))).alias("m"))


@query(" UNION ALL ".join(f"SELECT id, '{e}' AS key, {k} AS value, '{k}' AS source_field FROM ({_FIELDS}) WHERE coalesce({k}, '') <> ''" for k, e in _PLACES.items()))
def field_entities(spark, sf_dir):
    return _field_map(spark, sf_dir).select("id", F.inline(payload.entities(F.col("m"))))


_N_FILLED = " + ".join(f"(CASE WHEN coalesce({k}, '') <> '' THEN 1 ELSE 0 END)" for k in _FILLED)


@query(rf"""WITH f AS (SELECT *, {_N_FILLED} AS n FROM ({_FIELDS})) SELECT id, CAST(n AS INT) AS n_filled, n >= 4 AS is_valid, CASE WHEN n >= 4 THEN 'info' ELSE 'warning' END AS severity, nullif(trim(regexp_replace(address, '\s+', ' ', 'g')), '') AS first_present,
CASE WHEN starts_with(lower(template), 'pp_') OR contains(lower(template), 'passport') THEN 'passport' WHEN starts_with(lower(template), 'id_card') OR starts_with(lower(template), 'rp_') OR contains(lower(template), 'idcard') OR contains(lower(template), 'residence') THEN 'id_card' ELSE 'other' END AS document_type FROM f""")
def field_maps_judged(spark, sf_dir):
    """How many fields are filled, the gate, the first of two keys that is there (blank ones end the search), and the type that the template's name tells."""
    gate = payload.identity_gate(F.col("m"))
    return _field_map(spark, sf_dir).select("id", payload.populated(F.col("m")).alias("n_filled"), gate["is_valid"].alias("is_valid"), gate["severity"].alias("severity"), payload.first_present(F.col("m"), ("Residence", "ADDRESS", "surname")).alias("first_present"), payload.infer_type(F.col("template")).alias("document_type"))


_TWO = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'passport' WHEN 1 THEN 'id_card' WHEN 2 THEN 'driver_license' ELSE 'invoice' END AS kind, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_name END AS s1, CASE c_custkey % 5 WHEN 0 THEN '' ELSE lower(c_name) END AS s2, CASE c_custkey % 7 WHEN 0 THEN '01021980' WHEN 1 THEN '' ELSE concat('Y', CAST(c_custkey AS STRING)) END AS n1, CASE c_custkey % 11 WHEN 0 THEN NULL ELSE concat('Z', CAST(c_custkey AS STRING)) END AS n2 FROM customer"
_MERGED = "coalesce(nullif({0}1, ''), nullif({0}2, ''), {0}1)"


@query(f"""SELECT id, CASE WHEN kind = 'invoice' THEN s1 ELSE {_MERGED.format('s')} END AS surname, CASE WHEN kind = 'invoice' THEN n1 WHEN kind = 'driver_license' AND n1 = '01021980' THEN coalesce(n2, n1) ELSE {_MERGED.format('n')} END AS license_number, CASE WHEN kind <> 'invoice' THEN '7' END AS extra FROM ({_TWO})""")
def merged_field_maps(spark, sf_dir):
    """Field maps of two engines: blanks are filled, a licence's number that is a date gives way."""
    pairs = lambda n, *more: F.create_map(F.lit("surname"), f"s{n}", F.lit("license_number"), f"n{n}", *more)
    m = derive(spark, sf_dir, _TWO).select("id", payload.merge(F.col("kind"), pairs(1), pairs(2, F.lit("extra"), F.lit("7"))).alias("m"))
    return m.select("id", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("surname", "license_number", "extra")))


_YEARS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 > 0 THEN 1960 + o_orderkey % 70 END AS c, CASE WHEN o_orderkey % 3 > 0 THEN 1950 + o_custkey % 80 END AS o, CASE WHEN o_orderkey % 5 > 0 THEN 1950 + o_custkey % 40 END AS b, CASE WHEN o_orderkey % 7 > 1 THEN 2000 + o_custkey % 30 END AS e FROM orders"


@query(f"SELECT id, CASE WHEN c IS NULL OR coalesce(c <= b, false) OR coalesce(c >= e, false) THEN false WHEN o IS NULL OR coalesce(o <= b, false) OR coalesce(o >= e, false) THEN true ELSE c <= o END AS better FROM ({_YEARS})")
def issue_dates_judged(spark, sf_dir):
    day = lambda c: F.concat(F.lit("01/01/"), F.col(c).cast("string"))
    return derive(spark, sf_dir, _YEARS).select("id", dates.better_issue_date(day("c"), day("o"), day("b"), day("e")).alias("better"))


@query(f"WITH {ZONES} SELECT id, {_valid('l2')} AS valid, regexp_replace(l2, '[^A-Z0-9]', '', 'g') AS number FROM zones")
def second_lines(spark, sf_dir):
    return person_zones(spark, sf_dir).select("id", mrz.line2_valid(F.col("l2")).alias("valid"), text.document_number(F.lower("l2")).alias("number"))


_ASKED = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'passport' END AS asked, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '{}' WHEN 2 THEN concat('{\"document_type\": \"', lower(o_orderpriority), '\"}') ELSE '{\"document_type\": null}' END AS result, o_totalprice > 100000 AS good, o_orderkey % 5000 AS ms FROM orders"


@query(f"""SELECT id, CASE WHEN asked <> '' THEN asked WHEN id % 4 = 2 THEN json_extract_string(result, '$.document_type') END AS document_type, good AS is_valid, CASE WHEN good THEN 'fine' ELSE 'poor' END AS code, 'passport' AS requested, CAST(ms AS BIGINT) AS elapsed_ms FROM ({_ASKED})""")
def result_envelopes(spark, sf_dir):
    """Envelopes around results, with the type that was asked for or found."""
    a = derive(spark, sf_dir, _ASKED).withColumn("began", F.timestamp_millis(F.col("id") * 1000))
    verdict = {"is_valid": F.col("good"), "code": F.when(F.col("good"), "fine").otherwise("poor"), "severity": F.lit("info")}
    none = F.lit(None).cast("string")
    made = targets.envelope(F.lit("passport"), none, F.create_map(F.lit("a"), F.lit("1")), F.array(F.lit("x")), none, F.struct(*(c.alias(k) for k, c in verdict.items())), F.lit("e"), none, F.col("began"), F.timestamp_millis(F.col("id") * 1000 + F.col("ms")))
    e = a.select("id", jobs.document_type(F.col("asked"), F.col("result")).alias("document_type"), made.alias("e"))
    return e.select("id", "document_type", "e.validation.is_valid", F.get("e.validation.issues", F.lit(0))["code"].alias("code"), F.col("e.raw_result.requested_document_type").alias("requested"), F.col("e.processing_meta.elapsed_ms").cast("long").alias("elapsed_ms"))


#: Answers with a zone: two lines, one joined line, a bare first or second line, short lines that join, nothing.
_ZONE_ANSWER = "CASE id % 8 WHEN 0 THEN concat('Zone:', chr(10), l1, chr(13), chr(10), lower(l2)) WHEN 1 THEN concat(l1, ' ', l2) WHEN 2 THEN concat('x ', chr(10), l2) WHEN 3 THEN l1 WHEN 4 THEN ' NULL ' WHEN 5 THEN concat(substr(l1, 1, 15), chr(10), substr(l1, 16, 15), chr(10), substr(l1, 31), chr(10), substr(l2, 1, 19)) WHEN 6 THEN 'nothing' ELSE concat(l2, chr(13), l1, chr(10), l2) END"


@query(f"""WITH {ZONES} SELECT id, CASE id % 8 WHEN 2 THEN l2 WHEN 4 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN l2 ELSE l1 END AS line1, CASE id % 8 WHEN 0 THEN l2 WHEN 1 THEN l2 WHEN 5 THEN substr(l2, 1, 19) WHEN 7 THEN l1 END AS line2 FROM zones""")
def answer_zone_lines(spark, sf_dir):
    z = person_zones(spark, sf_dir).select("id", mrz.answer_lines(F.expr(_ZONE_ANSWER)).alias("z"))
    return z.select("id", F.col("z.l1").alias("line1"), F.col("z.l2").alias("line2"))


_NUMBER = "concat('\"N', CAST(o_orderkey AS STRING), '\"')"
_INVOICES = f"""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN concat('{{"header":{{"invoice_no":', {_NUMBER}, ',"extra":1}},"items":[{{"item_qty":"2"}}],"summary":{{"total_vat":"', CAST(o_custkey AS STRING), '"}},"more":[]}}')
WHEN 1 THEN concat('{{"total_vat":"', CAST(o_custkey AS STRING), '","invoice_no":', {_NUMBER}, ',"iban":null,"item_qty":"3","other":"x"}}') WHEN 2 THEN concat('{{"header":{{"invoice_no":', {_NUMBER}, '}},"total_net_worth":"', CAST(o_custkey AS STRING), '"}}') ELSE '{{"header":"none","other":2}}' END AS t FROM orders"""


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 IN (0, 2) THEN concat('N', o_orderkey) END AS invoice_no, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS STRING) END AS total_vat,
CASE o_orderkey % 4 WHEN 0 THEN concat('{{"header":{{"invoice_no":', {_NUMBER}, ',"extra":1}},"items":[{{"item_qty":"2"}}],"summary":{{"total_vat":"', o_custkey, '"}}}}') WHEN 1 THEN concat('{{"header":{{"invoice_no":', {_NUMBER}, ',"iban":null}},"items":[{{"item_qty":"3"}}],"summary":{{"total_vat":"', o_custkey, '"}}}}')
WHEN 2 THEN concat('{{"header":{{"invoice_no":', {_NUMBER}, '}},"summary":{{"total_net_worth":"', o_custkey, '"}}}}') ELSE '{{}}' END AS simplified FROM orders""")
def invoice_truths(spark, sf_dir):
    """Ground truths by parts or flat: two of their fields, and the simplified form."""
    t = derive(spark, sf_dir, _INVOICES, ("orders",)).select("id", invoice.truth(F.col("t")).alias("f"), invoice.simplified(F.col("t"), True).alias("simplified"))
    return t.select("id", "f.invoice_no", "f.total_vat", "simplified")


_NOISY = "SELECT doc_id, concat(chr(9), '<|end|> ', replace(text, ' ', concat(' ', chr(9))), chr(92), 'n', chr(13), 'tail', chr(92), 'r ', chr(9), '<|end|>') AS t FROM documents"


@query(rf"""WITH n AS ({_NOISY}), r AS (SELECT doc_id, replace(replace(replace(replace(t, '<|end|>', ''), chr(92) || 'r', chr(10)), chr(92) || 'n', chr(10)), chr(13), chr(10)) AS t FROM n), s AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ 	]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM r)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5, substr(t, 1, 500) AS preview FROM s""")
def quiet_texts(spark, sf_dir):
    """Whole texts without a recogniser's noise, and their previews."""
    t = derive(spark, sf_dir, _NOISY).select("doc_id", passport.without_noise(F.col("t"), ("<|end|>",)).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"), passport.preview(F.col("t")).alias("preview"))


_SHOWN = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{cut' WHEN 1 THEN NULL ELSE concat('{"a": {"b": "', event_type, '", "c": ', CAST(user_id AS STRING), ', "d": null}, "l": [1, 2.0, true, null, "', event_type, '"], "o": [{"x": ', CASE WHEN event_id % 5 = 0 THEN '[]' ELSE '2.5' END, '}, [false]], "e": []}') END AS t FROM events"""


@query("""SELECT event_id, unnest(p) AS path, unnest(k) AS label_key, unnest(v) AS value FROM (SELECT event_id, ['a.b', 'a.c', 'l', 'o[1]'] || CASE WHEN event_id % 5 = 0 THEN [] ELSE ['o[0].x'] END AS p, ['b', 'c', 'l', 'o[1]'] || CASE WHEN event_id % 5 = 0 THEN [] ELSE ['x'] END AS k,
[event_type, CAST(user_id AS VARCHAR), concat('1, 2, true, null, ', event_type), 'false'] || CASE WHEN event_id % 5 = 0 THEN [] ELSE ['2.5'] END AS v FROM events WHERE event_id % 6 > 1)""")
def shown_records(spark, sf_dir):
    """Records as the rows of a page."""
    return derive(spark, sf_dir, _SHOWN).select("event_id", F.inline(display.shown_fields("t")))
