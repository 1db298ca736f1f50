"""Queries of engines, reused results, counted rejects, the zone pipeline, targets and the status stream, each with the same result as SQL."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from scriptorium.functions import display, evaluation, targets
from scriptorium.operators import engines, imports, memo, zones
from scriptorium.plans.fixtures import PERSONS, derive
from scriptorium.plans.queries import SQL, THIS_YEAR, ZONES, _ISO, _TABLE, _valid, query, table
from scriptorium.plans.queries import zones as person_zones
from scriptorium.sources import metadata
from scriptorium.sources.shared import new_folder, stream_of
from scriptorium.streaming import status, worker


def _length() -> engines.Engine:
    return lambda raw: str(len(raw))


def _picky() -> engines.Engine:
    def recognise(raw: bytes) -> str:
        if len(raw) % 2:
            raise ValueError("odd")
        return f"even {len(raw)}"

    return recognise


def _broken() -> engines.Engine:
    raise RuntimeError("no model")


_ASKED = "CASE page_id % 7 WHEN 0 THEN 'picky' WHEN 1 THEN 'broken' WHEN 2 THEN 'none' WHEN 3 THEN '' END"
_KIND = "CASE page_id % 2 WHEN 0 THEN 'invoice' ELSE 'passport' END"


@query(f"""WITH p AS (SELECT page_id AS id, coalesce(nullif({_ASKED}, ''), CASE WHEN {_KIND} = 'invoice' THEN 'donut' ELSE 'paddleocr_vl' END) AS engine, octet_length(encode(html)) AS n FROM pages)
SELECT id, engine, CASE WHEN engine = 'picky' AND n % 2 = 0 THEN concat('even ', n) WHEN engine IN ('donut', 'paddleocr_vl') THEN CAST(n AS STRING) END AS text,
CASE engine WHEN 'broken' THEN 'no model' WHEN 'none' THEN 'Unsupported extraction engine: none' WHEN 'picky' THEN CASE WHEN n % 2 = 1 THEN 'odd' END END AS error FROM p""")
def engine_dispatch(spark, sf_dir):
    """Every page by the engine that it asks for, in one pass."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").cast("binary").alias("content"), engines.wanted(F.expr(_ASKED), F.expr(_KIND)).alias("engine"))
    return engines.dispatched(p, {"picky": _picky, "broken": _broken, "donut": _length, "paddleocr_vl": _length}).select("id", "engine", "text", "error")


@pandas_udf(LongType())
def _crc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: zlib.crc32(t.encode()))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), o AS (SELECT DISTINCT text FROM t WHERE doc_id % 3 = 0), n AS (SELECT count(DISTINCT text) AS n_new FROM t WHERE text NOT IN (SELECT text FROM o))
SELECT doc_id AS id, CAST(length(text) AS BIGINT) AS n_chars, CASE WHEN text IN (SELECT text FROM o) THEN 1 ELSE 2 END AS computed_in, CAST(n_new AS BIGINT) AS n_computed FROM t, n""")
def reused_results(spark, sf_dir):
    """A run over a third of the documents, then one over all: the second computes only texts that the first hasn't seen."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    kept = memo.Memo(spark, new_folder(spark, "memo"), "n_chars long, crc long, computed_in int")
    compute = lambda n: lambda rows: rows.select("memo_key", F.length("text").cast("long").alias("n_chars"), _crc("text").alias("crc"), F.lit(n).alias("computed_in"))
    kept.apply(docs.where("id % 3 = 0"), compute(1), memo.content_key("text"), 1)
    found, n = kept.apply(docs, compute(2), memo.content_key("text"), 2)
    return found.select("id", "result.n_chars", "result.computed_in", F.lit(n).cast("long").alias("n_computed"))


@query("""SELECT count(*) FILTER (WHERE html LIKE '%<title>%') AS n_good, CAST(coalesce(sum(octet_length(encode(html))) FILTER (WHERE html LIKE '%<title>%'), 0) AS BIGINT) AS n_bytes, count(*) AS n_rows, count(*) FILTER (WHERE html NOT LIKE '%<title>%' OR html IS NULL) AS n_rejected FROM pages""")
def counted_rejects(spark, sf_dir):
    """Pages with a title, and how many have none, from one pass."""
    good, seen = metadata.scanned(table(spark, sf_dir, "pages"), F.col("html").contains("<title>"))
    kept = good.agg(F.count("*").alias("n_good"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).cast("long").alias("n_bytes")).first()
    return spark.createDataFrame([(kept["n_good"], kept["n_bytes"], seen.get["n_rows"], seen.get["n_rejected"])], "n_good long, n_bytes long, n_rows long, n_rejected long")


#: Recognised text of zones: whole, joined, with one line, damaged in the second line, without a zone.
ZONE_TEXT = "CASE id % 9 WHEN 0 THEN concat('zone', chr(10), l1, chr(10), l2) WHEN 1 THEN concat(l1, l2) WHEN 2 THEN l1 WHEN 3 THEN l2 WHEN 4 THEN 'nothing here' WHEN 5 THEN concat(lower(l1), chr(10), lower(l2)) WHEN 6 THEN concat(l1, chr(10), substr(l2, 1, 30)) ELSE concat(l1, chr(10), ' ', l2, ' ') END"
_SECOND = "[A-Z0-9<]{9}[0-9<][A-Z]{3}[0-9]{6}[0-9<][MFX<]"


@query(rf"""WITH {ZONES}, t AS (SELECT id, [x for x in [regexp_replace(upper(y), '[^A-Z0-9<]', '', 'g') for y in string_split({ZONE_TEXT}, chr(10))] if x <> ''] AS ls FROM zones),
a AS (SELECT id, [x for x in ls if length(x) >= 28] AS long_, array_to_string(ls, '') AS joined FROM t), b AS (SELECT *, CASE WHEN regexp_matches(joined, '{_SECOND}') THEN instr(joined, regexp_extract(joined, '{_SECOND}')) ELSE 0 END AS p FROM a),
s AS (SELECT id, CASE WHEN len(long_) >= 2 THEN long_[-2] WHEN p > 2 THEN substr(joined, 1, p - 1) WHEN len(long_) = 1 AND starts_with(long_[1], 'P<') THEN long_[1] ELSE '' END AS l1, CASE WHEN len(long_) >= 2 THEN long_[-1] WHEN p > 2 THEN substr(joined, p) WHEN len(long_) = 1 AND NOT starts_with(long_[1], 'P<') THEN long_[1] ELSE '' END AS l2 FROM b),
f AS (SELECT *, rpad(substr(l2, 1, 44), 44, '<') AS l2p FROM s), bad AS (SELECT id, l2p FROM f WHERE l2 <> '' AND NOT {_valid('l2p')}),
tried AS (SELECT id, p * 10 + t.n AS rank, concat(substr(l2p, 1, CAST(p AS INT) - 1), t.alt, substr(l2p, CAST(p AS INT) + 1)) AS cand FROM bad, range(1, 45) r(p), (VALUES {_TABLE}) t(ch, n, alt) WHERE substr(l2p, CAST(p AS INT), 1) = t.ch),
good AS (SELECT id, min_by(cand, rank) AS cand FROM tried WHERE {_valid('cand')} GROUP BY id),
z AS (SELECT f.id AS id, l1, l2, CASE WHEN l2 = '' THEN NULL WHEN {_valid('l2p')} THEN 0 WHEN good.id IS NOT NULL THEN 1 ELSE -1 END AS n_edits, good.cand AS cand FROM f LEFT JOIN good ON good.id = f.id),
y AS (SELECT id, CASE WHEN l1 <> '' AND l2 <> '' THEN 'two_lines' WHEN l1 <> '' THEN 'first_only' WHEN l2 <> '' THEN 'second_only' ELSE 'none' END AS split, n_edits, l1, CASE WHEN n_edits > 0 THEN cand ELSE l2 END AS l2 FROM z),
x AS (SELECT *, rpad(substr(l2, 1, 44), 44, '<') AS l2p FROM y), w AS (SELECT *, split = 'two_lines' AND length(l1) >= 10 AND length(l2) >= 28 AND substr(l1, 1, 1) IN ('P', 'V') AND {_valid('l2p')} AS valid FROM x)
SELECT id, split, coalesce(n_edits > 0, false) AS corrected, valid, CASE WHEN valid THEN 'valid' WHEN n_edits >= 0 THEN 'corrected' WHEN split <> 'none' THEN 'split' ELSE 'none' END AS stage, CASE WHEN split <> 'none' THEN nullif(replace(substr(l2p, 1, 9), '<', ''), '') END AS document_number,
CASE WHEN split <> 'none' THEN {_ISO.format(c="CASE WHEN TRY_CAST(substr(l2p, 14, 2) AS INT) > 25 THEN '19' ELSE '20' END", d='substr(l2p, 14, 6)')} END AS date_of_birth FROM w""")
def zone_pipeline(spark, sf_dir):
    """All texts through the pipeline with single substitutions; those by pairs are compared with brute force in the tests."""
    texts = person_zones(spark, sf_dir).select("id", F.expr(ZONE_TEXT).alias("t"))
    found = zones.pipeline(texts, "t", "id", THIS_YEAR, most_edits=1)
    return found.select("id", "split", "corrected", "valid", "stage", "fields.document_number", "fields.date_of_birth")


@query(f"SELECT stage, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM ({SQL['zone_pipeline']}) GROUP BY stage")
def zone_shares(spark, sf_dir):
    """How far the zones of texts come in the pipeline."""
    texts = person_zones(spark, sf_dir).select("id", F.expr(ZONE_TEXT).alias("t"))
    return zones.shares(zones.pipeline(texts, "t", "id", THIS_YEAR, most_edits=1)).select("stage", "n", F.round("share", 9).alias("share"))


_RECORDS = f"SELECT id, CASE id % 3 WHEN 0 THEN 'passport' WHEN 1 THEN 'driver_license' ELSE 'receipt' END AS kind, surname, CASE WHEN id % 4 = 0 THEN NULL ELSE given END AS given, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('P<', country, chr(10), number) END AS mrz FROM ({PERSONS})"


def _target_sql() -> str:
    field = {"surname": "surname", "given_names": "given", "mrz": "mrz"}
    flat = ", chr(10), ".join(f"'{k}: ', coalesce({field.get(k, 'NULL')}, 'null')" for k in targets.FLAT_KEYS)
    prompts = " ".join(f"WHEN '{k}' THEN length('{targets.prompt_of(k)}')" for k in ("passport", "driver_license", "receipt"))
    return f"SELECT id, CAST(CASE kind {prompts} END AS BIGINT) AS n_prompt, CASE WHEN kind = 'passport' THEN concat({flat}) ELSE '-' END AS flat, CASE WHEN kind = 'passport' THEN coalesce(nullif(mrz, ''), 'null') ELSE '-' END AS zone FROM ({_RECORDS})"


@query(_target_sql())
def target_texts(spark, sf_dir):
    r = derive(spark, sf_dir, _RECORDS)
    fields = F.create_map(F.lit("surname"), "surname", F.lit("given_names"), "given", F.lit("mrz"), "mrz")
    only = lambda form: F.when(F.col("kind") == "passport", targets.target(F.col("kind"), fields, form)).otherwise("-")
    return r.select("id", F.length(targets.prompt(F.col("kind"))).cast("long").alias("n_prompt"), only("passport_flat").alias("flat"), only("passport_mrz").alias("zone"))


_OTHERS = "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN concat(' A', CAST(c_custkey AS STRING)) WHEN 1 THEN '' END AS pass_num, CASE WHEN c_custkey % 2 = 0 THEN concat('B ', CAST(c_custkey AS STRING)) ELSE ' ' END AS passport_number, concat('X / ', c_mktsegment, ', y') AS surname, CASE c_custkey % 4 WHEN 0 THEN 'Ann' WHEN 1 THEN '' END AS given_name, CASE WHEN c_custkey % 5 < 3 THEN concat('Lou  ', c_mktsegment) END AS given_names, CASE c_custkey % 6 WHEN 0 THEN 'russian' WHEN 1 THEN ' utopia ' END AS nationality, CASE WHEN c_custkey % 7 < 4 THEN 'rus' END AS nationality_code, CASE c_custkey % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'X/F' WHEN 2 THEN 'other' END AS sex FROM customer"
_CODES = {"RUS": "RUSSIAN FEDERATION", "RUSSIAN": "RUSSIAN FEDERATION"}
_SQUASH = r"nullif(trim(regexp_replace({c}, '\s+', ' ', 'g')), '')"


def _mapped_sql() -> str:
    q = lambda c: _SQUASH.format(c=c)
    known = lambda c: f"CASE upper({q(c)}) WHEN 'RUS' THEN 'RUSSIAN FEDERATION' WHEN 'RUSSIAN' THEN 'RUSSIAN FEDERATION' ELSE upper({q(c)}) END"
    name = lambda c: q(f"replace(string_split({q(c)}, ' / ')[-1], ',', ' ')")
    sex = f"CASE WHEN starts_with(upper({q('sex')}), 'M') OR contains(upper({q('sex')}), '/M') THEN 'M' WHEN starts_with(upper({q('sex')}), 'F') OR contains(upper({q('sex')}), '/F') THEN 'F' ELSE substr(upper({q('sex')}), 1, 1) END"
    return f"""SELECT id, {q("coalesce(nullif(pass_num, ''), nullif(passport_number, ''))")} AS document_number, {name('surname')} AS surname, {name("coalesce(nullif(given_name, ''), nullif(given_names, ''))")} AS given_names, coalesce({known('nationality')}, {known('nationality_code')}) AS nationality, {sex} AS sex FROM ({_OTHERS})"""


@query(_mapped_sql())
def mapped_passports(spark, sf_dir):
    o = derive(spark, sf_dir, _OTHERS)
    raw = F.create_map(*(x for c in o.columns[1:] for x in (F.lit(c), F.col(c))))
    return o.select("id", targets.mapped_passport(raw, _CODES).alias("m")).select("id", "m.document_number", "m.surname", "m.given_names", "m.nationality", "m.sex")


_ACTION = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'start' WHEN 'click' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'retry' END"


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS job, ts, {_ACTION} AS action, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS last_n FROM events),
t AS (SELECT '' AS f, 'create' AS a, 'queued' AS s UNION ALL SELECT 'queued', 'start', 'processing' UNION ALL SELECT 'processing', 'finish', 'done' UNION ALL SELECT 'processing', 'fail', 'failed' UNION ALL SELECT s, 'retry', 'queued' FROM (VALUES ('queued'), ('processing'), ('done'), ('failed')) v(s)),
r AS (SELECT job, CAST(0 AS BIGINT) AS n, '' AS status, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS TIMESTAMP) AS finished_at, CAST(NULL AS VARCHAR) AS result, CAST(0 AS BIGINT) AS n_applied FROM e WHERE n = 1 UNION ALL
SELECT r.job, e.n, coalesce(t.s, r.status), CASE WHEN t.s IN ('queued', 'done') THEN NULL WHEN t.s = 'failed' THEN e.props ELSE r.error END, CASE WHEN t.s = 'queued' THEN NULL WHEN t.s IN ('done', 'failed') THEN e.ts ELSE r.finished_at END, CASE WHEN t.s = 'done' THEN e.props ELSE r.result END, r.n_applied + CASE WHEN t.s IS NULL THEN 0 ELSE 1 END FROM r JOIN e ON e.job = r.job AND e.n = r.n + 1 LEFT JOIN t ON t.f = r.status AND t.a = e.action)
SELECT r.job AS job, status, error, finished_at, result, n_applied, r.n - n_applied AS n_rejected FROM r JOIN (SELECT DISTINCT job, last_n FROM e) l ON l.job = r.job AND l.last_n = r.n""")
def job_status_stream(spark, sf_dir):
    """The states that a stream of actions leaves."""
    actions = stream_of(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.expr(_ACTION).alias("action"), F.col("ts").alias("at"), F.col("props").alias("detail"))
    sink = new_folder(spark, "states")
    status.run(actions, sink, new_folder(spark, "state-checkpoint")).awaitTermination()
    return status.states(spark, sink).select("job", "status", "error", "finished_at", "result", "n_applied", "n_rejected")


_ACCENTED = "SELECT c_custkey AS id, k AS key, concat(' ', substr('ŠšŻżŐőĞğŁłÇçẤấÑñØøÝý', CAST(c_custkey % 20 AS INT) + 1, 3), ' ', c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN '’s, e.. x' ELSE '' END) AS value FROM customer CROSS JOIN (SELECT 'surname' AS k UNION ALL SELECT 'document_number' UNION ALL SELECT 'mrz' UNION ALL SELECT 'sex' UNION ALL SELECT 'other') x"


@query(rf"""WITH a AS (SELECT id, key, trim(regexp_replace(upper(strip_accents(value)), '\s+', ' ', 'g')) AS v FROM ({_ACCENTED}))
SELECT id, key, CASE key WHEN 'document_number' THEN regexp_replace(v, '[^A-Z0-9]', '', 'g') WHEN 'mrz' THEN replace(v, ' ', '') WHEN 'sex' THEN substr(v, 1, 1) WHEN 'surname' THEN trim(regexp_replace(regexp_replace(replace(v, ',', ' '), '[.]+', '.', 'g'), ' +', ' ', 'g')) ELSE v END AS value FROM a""")
def accented_fields(spark, sf_dir):
    return derive(spark, sf_dir, _ACCENTED).select("id", "key", evaluation.by_field(F.col("key"), F.col("value")).alias("value"))


_ERROR = "CASE o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Could NOT even extract' WHEN 3 THEN 'could not read' WHEN 4 THEN concat('Loop after ', CAST(o_orderkey AS STRING)) WHEN 5 THEN 'Модель НЕ смогла извлечь поля' WHEN 6 THEN 'Job not found, unsupported operand type' WHEN 7 THEN 'Engine supports only invoice extraction' WHEN 8 THEN 'x is not wired into the pipeline yet' WHEN 9 THEN 'schema_mapping_not_implemented' WHEN 10 THEN 'The identity-document parser found too few fields.' WHEN 11 THEN 'file NOT FOUND' ELSE concat('other ', o_orderpriority) END"
_JOB_ERRORS = f"SELECT o_orderkey AS id, {_ERROR} AS error, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'paused' END AS status FROM orders"


def _display_sql() -> str:
    holds = lambda p: f"contains(lower(error), '{p}')"
    messages = " ".join(f"WHEN {' AND '.join(map(holds, parts))} THEN '{said}'" for parts, said in display.ERRORS)
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in display.STATUS.items())
    return f"SELECT id, CASE status {labels} ELSE status END AS status, CASE WHEN coalesce(error, '') = '' THEN NULL {messages} ELSE error END AS error FROM ({_JOB_ERRORS})"


@query(_display_sql())
def job_display(spark, sf_dir):
    j = derive(spark, sf_dir, _JOB_ERRORS)
    return j.select("id", display.status_label(F.col("status")).alias("status"), display.friendly_error(F.col("error")).alias("error"))


_PAGES = "SELECT conv_id AS doc_id, turn AS page, role AS kind, text AS raw_text, CASE WHEN turn % 3 = 0 THEN '' ELSE concat('field', CAST(turn AS STRING)) END AS source_field FROM conversations"


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS n, count(*) OVER (PARTITION BY doc_id) AS c FROM ({_PAGES}))
SELECT doc_id, arg_min(kind, n) AS name, string_agg(concat(kind, '=', substr(raw_text, 1, 9), '@', CASE WHEN n = 1 THEN source_field ELSE concat('page', n, ':', coalesce(nullif(source_field, ''), kind)) END), '|' ORDER BY n) AS entities, coalesce(string_agg(raw_text, chr(10) || chr(10) ORDER BY n) FILTER (WHERE raw_text <> ''), '') AS raw_text, CASE WHEN max(c) > 1 THEN 'multipage' END AS raw_mode, CAST(max(c) AS INT) AS page_count FROM p GROUP BY doc_id""")
def merged_results(spark, sf_dir):
    """Results of the turns of conversations, as pages with an entity each, as one."""
    p = derive(spark, sf_dir, _PAGES)
    said = F.coalesce(F.substring("raw_text", 1, 9), F.lit(""))
    pages = p.select("doc_id", "page", F.to_json(F.create_map(F.lit("name"), "kind")).alias("fields"), F.array(F.struct(F.col("kind").alias("key"), said.alias("value"), "source_field")).alias("entities"), "raw_text")
    m = worker.merge_results(pages)
    return m.select("doc_id", F.get_json_object("fields", "$.name").alias("name"), F.array_join(F.transform("entities", lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit("@"), e["source_field"])), "|").alias("entities"), "raw_text", "raw_mode", "page_count")


_CANDIDATES = "SELECT CAST(doc_id AS STRING) AS id, lang AS fields, 'needs_annotation' AS status FROM documents"
_DRAFTS = "SELECT CAST(doc_id % 300 * 2 AS STRING) AS id, concat('d', CAST(doc_id AS STRING)) AS fields, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS source, doc_id AS line_no FROM labels"


@query(f"""WITH c AS ({_CANDIDATES}), d AS (SELECT id, arg_max(fields, line_no) AS fields, arg_max(source, line_no) AS source FROM ({_DRAFTS}) GROUP BY id)
SELECT c.id AS id, CASE WHEN d.id IS NULL THEN c.fields ELSE d.fields END AS fields, CASE WHEN d.id IS NULL THEN c.status ELSE 'draft_from_previous_experiment' END AS status, d.source AS draft_source FROM c LEFT JOIN d ON d.id = c.id""")
def drafted_candidates(spark, sf_dir):
    return imports.with_drafts(derive(spark, sf_dir, _CANDIDATES), derive(spark, sf_dir, _DRAFTS), "draft_from_previous_experiment")
