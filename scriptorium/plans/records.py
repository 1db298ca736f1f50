"""Queries of record gates, passport text, evaluation, imports and run reports, each with the same result as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import evaluation, gates, jsonops, passport, text
from scriptorium.operators import imports, metrics, reports
from scriptorium.plans.fixtures import DATASET, EXPECTED, JOBS, PREDICTED, derive
from scriptorium.plans.queries import _SCORES, fields, query, table

_PAIRS = """SELECT c_custkey AS id, concat('x {"document_type": "a", "name" : " ', c_name, ' ", "segment":"', CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_mktsegment END, '", "text": "t", "type": "k", "name":"', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(c_name, '2') END, '", "n": 5, "open": "') AS t FROM customer"""
_PAIR = '"([A-Za-z0-9_]+)"\\s*:\\s*"([^"]*)"'


@query(f"""WITH t AS ({_PAIRS}), l AS (SELECT id, regexp_extract_all(t, '{_PAIR}', 1) AS k, regexp_extract_all(t, '{_PAIR}', 2) AS v FROM t),
p AS (SELECT id, k[i] AS key, trim(v[i]) AS value, i FROM l, unnest(range(1, len(k) + 1)) AS r(i))
SELECT id, key, max_by(value, i) AS value FROM p WHERE value <> '' AND key NOT IN ('document_type', 'document_content', 'text', 'text_content', 'text_version') GROUP BY id, key""")
def json_pairs(spark, sf_dir):
    t = derive(spark, sf_dir, _PAIRS)
    return t.select("id", F.explode(jsonops.salvage(F.col("t"))).alias("key", "value"))


_VALUES = """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('AB', lpad(CAST(c_custkey AS STRING), 6, '0')) WHEN 2 THEN lower(c_name) WHEN 3 THEN concat('X', CAST(c_custkey AS STRING)) ELSE concat('AB', lpad(CAST(c_custkey AS STRING), 6, '0'), chr(10)) END AS number,
  CASE c_custkey % 4 WHEN 0 THEN 'USA' WHEN 1 THEN 'US' WHEN 2 THEN 'usa' END AS nationality, substr('MFXU', CAST(c_custkey % 4 AS INT) + 1, 1) AS sex,
  concat('L', lpad(CAST(c_custkey AS STRING), 8, '0'), '1UTO740812', substr('MF<Q', CAST(c_custkey % 4 AS INT) + 1, 1), '120415', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'AB' END) AS line2,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Date of' WHEN 2 THEN '12-34' WHEN 3 THEN 'O''NEILL' WHEN 4 THEN ' passport. ' ELSE c_name END AS name,
  CASE c_custkey % 4 WHEN 0 THEN 'See https://x' WHEN 1 THEN 'Holder''s Signature' WHEN 2 THEN NULL ELSE c_mktsegment END AS remark,
  CASE WHEN c_custkey % 3 = 0 THEN 'a/RUS-printed-2' WHEN c_custkey % 3 = 1 THEN 'b' END AS source, CASE WHEN c_custkey % 7 = 0 THEN 'Russian Federation' ELSE c_mktsegment END AS country,
  CASE WHEN c_custkey % 5 = 0 THEN true WHEN c_custkey % 5 = 1 THEN false END AS template, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 8 END AS populated FROM customer"""
_LINE2 = "^[A-Z0-9<]{9}[0-9][A-Z]{3}[0-9]{6}[MFX<][0-9]{6}"


@query(f"""SELECT id, coalesce(regexp_full_match(number, '[A-Z0-9]{{7,10}}'), false) AS number, coalesce(regexp_full_match(nationality, '[A-Z]{{3}}'), false) AS nationality, sex IN ('M', 'F', 'X') AS sex,
length(line2) >= 28 AND length(replace(line2, '<', '')) >= 20 AND regexp_matches(line2, '{_LINE2}') AS line2,
coalesce(trim(regexp_replace(upper(name), '[^A-Z ]', '', 'g')) NOT IN ('', 'NO', 'OF', 'ISSUE', 'DATE OF', 'DATE', 'BIRTH', 'PLACE', 'PASSPORT', 'AUTHORITY', 'UNITED'), false) AS name FROM ({_VALUES})""")
def value_gates(spark, sf_dir):
    c = F.col
    return derive(spark, sf_dir, _VALUES).select("id", gates.plausible_number(c("number")).alias("number"), gates.plausible_nationality(c("nationality")).alias("nationality"), gates.plausible_sex(c("sex")).alias("sex"), gates.like_second_line(c("line2")).alias("line2"), gates.useful_name(c("name")).alias("name"))


_BAD = "coalesce(regexp_matches(lower({c}), 'signature|holder|http://|https://|issuing authority|the following is a sample|class|end none'), false)"


@query(f"""SELECT id, coalesce(template, false) = false AND id % 2 = 0 AND coalesce(populated >= 4, false) AS real, coalesce(contains(lower(source), 'rus'), false) OR coalesce(upper(country) = 'RUSSIAN FEDERATION', false) AS russian,
coalesce(contains(lower(source), 'printed-'), false) AS printed, CAST({_BAD.format(c='remark')} AS INT) + CAST({_BAD.format(c='name')} AS INT) AS issues FROM ({_VALUES})""")
def record_gates(spark, sf_dir):
    c = F.col
    return derive(spark, sf_dir, _VALUES).select("id", gates.is_real_record(c("template"), c("id") % 2 == 0, c("populated")).alias("real"), gates.is_from(c("source"), c("country"), "rus", "RUSSIAN FEDERATION").alias("russian"), gates.is_printed(c("source")).alias("printed"), gates.issue_count([c("remark"), c("name")]).alias("issues"))


_SAID = """SELECT c_custkey AS id, concat('Passport Name', chr(10), 'ALL UPPER', chr(10), '1 one', chr(10), CASE c_custkey % 6 WHEN 0 THEN concat('Anna-Maria / Lou  ', substr(c_mktsegment, 1, 1), lower(substr(c_mktsegment, 2)), '-Smith 7') WHEN 1 THEN concat('Lou ', c_mktsegment) WHEN 2 THEN concat(lower(c_mktsegment), ' type') WHEN 3 THEN concat('x ', c_mktsegment, ' -') ELSE concat('DATE OF BIRTH ', CAST(c_custkey AS STRING)) END, chr(10), CASE WHEN c_custkey % 5 = 0 THEN 'no Marker' ELSE '<s>end <pad></s>' END) AS t,
  concat_ws(' ', CASE c_custkey % 7 WHEN 0 THEN '05/06/1990' WHEN 1 THEN '05.06.1990' WHEN 2 THEN '5/6/1990' WHEN 3 THEN '05-06-90x' WHEN 4 THEN '12 Mar 2020' WHEN 5 THEN '112/03/2020' END, 'x', CASE c_custkey % 5 WHEN 0 THEN '07/08/2020, 09/10/2030' WHEN 1 THEN '07.08.20' WHEN 2 THEN '1 Jan 2020' WHEN 3 THEN concat(lpad(CAST(c_custkey % 31 AS STRING), 2, '0'), ' Nov 2031') END, CASE WHEN c_custkey % 3 = 0 THEN concat('01-02-20', lpad(CAST(c_nationkey AS STRING), 2, '0')) END) AS d FROM customer"""
_DATE = r"\b(?:[0-9]{2}[./-][0-9]{2}[./-][0-9]{2,4}|[0-9]{2}\s+[A-Z][a-z]{2}\s+[0-9]{4})\b"


@query(rf"""WITH s AS ({_SAID}), a AS (SELECT id, trim(replace(replace(replace(t, '<pad>', ''), '</s>', ''), '<s>', '')) AS plain_text, [trim(x) for x in string_split(t, chr(10)) if trim(x) <> ''] AS ls, regexp_extract_all(d, '{_DATE}') AS d FROM s),
w AS (SELECT id, i, [x for x in string_split(trim(regexp_replace(replace(ls[i], '/', ' '), '\s+', ' ', 'g')), ' ') if regexp_full_match(x, '[A-Za-z-]+')] AS ws FROM a, unnest(range(1, len(ls) + 1)) r(i)),
n AS (SELECT id, arg_min(ws, i) AS ws FROM w WHERE len(ws) >= 2 AND len([x for x in ws if upper(x) IN ('UNITED', 'COUNTRY', 'CODE', 'PASSPORT', 'NAME', 'NAMES', 'NATIONALITY', 'TYPE', 'PLACE', 'BIRTH')]) = 0 AND len([x for x in ws if regexp_matches(x, '[a-z]')]) > 0 AND trim(replace(ws[-1], '-', ' ')) <> '' GROUP BY id)
SELECT a.id AS id, trim(replace(upper(ws[-1]), '-', ' ')) AS surname, nullif(trim(replace(upper(array_to_string(ws[:-2], ' ')), '-', ' ')), '') AS given_names, [x for x in ls if contains(upper(x), 'DATE OF') OR contains(upper(x), 'NO MARKER')][1] AS marked,
d[1] AS birth, d[2] AS issue, CASE WHEN len(d) >= 2 THEN coalesce(d[3], d[2]) END AS expiry, plain_text FROM a LEFT JOIN n ON n.id = a.id""")
def passport_lines(spark, sf_dir):
    c = F.col
    s = derive(spark, sf_dir, _SAID).select("id", "t", passport.ordinal_dates(c("d")).alias("d"), text.lines(c("t")).alias("ls"))
    s = s.select("id", "t", "d", passport.name_line(c("ls")).alias("n"), passport.first_line(c("ls"), ("DATE OF", "NO MARKER")).alias("marked"))
    return s.select("id", "n.surname", "n.given_names", "marked", "d.birth", "d.issue", "d.expiry", passport.without_special(c("t")).alias("plain_text"))


_FIELDS = """SELECT c_custkey AS id, k AS key, CASE k WHEN 'document_number' THEN concat(' ab-', CAST(c_custkey AS STRING), ' ç') WHEN 'date_of_birth' THEN CASE c_custkey % 8 WHEN 0 THEN '3 mar 2020' WHEN 1 THEN '03/4/2020' WHEN 2 THEN ' 1-02-1999 ' WHEN 3 THEN '12 XYZ 2020' WHEN 4 THEN concat(CAST(c_custkey % 28 + 1 AS STRING), ' Déc 1990') WHEN 5 THEN '2020.01.02' WHEN 6 THEN '1.2.20' ELSE '12  aug  2001' END WHEN 'mrz' THEN concat('p<uto  x y', lower(c_mktsegment)) WHEN 'sex' THEN CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE ' m' END WHEN 'nationality' THEN CASE c_custkey % 7 WHEN 0 THEN 'are' WHEN 1 THEN 'Française' WHEN 2 THEN 'usa' WHEN 3 THEN 'russo' WHEN 4 THEN 'émirats  arabes unis' WHEN 5 THEN concat('x, ', c_mktsegment) ELSE 'x, y' END
  WHEN 'surname' THEN concat('O, ', c_name, '...x') ELSE concat(' é  ', c_mktsegment) END AS value FROM customer CROSS JOIN (SELECT 'document_number' AS k UNION ALL SELECT 'date_of_birth' UNION ALL SELECT 'mrz' UNION ALL SELECT 'sex' UNION ALL SELECT 'nationality' UNION ALL SELECT 'surname' UNION ALL SELECT 'other') x"""


_PLAIN_VALUE = r"trim(regexp_replace(upper(strip_accents(value)), '\s+', ' ', 'g'))"
_NAMED = "trim(regexp_replace(regexp_replace(replace(v, ',', ' '), '[.]+', '.', 'g'), ' +', ' ', 'g'))"
_MONTHS = "list_position(['JAN', 'FEB', 'MAR', 'APR', 'MAY', 'JUN', 'JUL', 'AUG', 'SEP', 'OCT', 'NOV', 'DEC'], regexp_extract(d, '^([0-9]{1,2}) ([A-Z]{3}) ([0-9]{4})$', 2))"


@query(rf"""WITH a AS (SELECT id, key, {_PLAIN_VALUE} AS v FROM ({_FIELDS})), b AS (SELECT *, translate(v, '/-', '..') AS d, {_NAMED} AS n FROM a)
SELECT id, key, CASE key WHEN 'document_number' THEN regexp_replace(v, '[^A-Z0-9]', '', 'g') WHEN 'date_of_birth' THEN CASE WHEN {_MONTHS} > 0 THEN concat(lpad(regexp_extract(d, '^[0-9]+'), 2, '0'), '.', lpad(CAST({_MONTHS} AS VARCHAR), 2, '0'), '.', right(d, 4)) WHEN regexp_full_match(d, '[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}}') THEN concat(lpad(string_split(d, '.')[1], 2, '0'), '.', lpad(string_split(d, '.')[2], 2, '0'), '.', string_split(d, '.')[3]) ELSE d END
WHEN 'mrz' THEN replace(v, ' ', '') WHEN 'sex' THEN substr(v, 1, 1) WHEN 'nationality' THEN CASE WHEN n = 'ARE' THEN 'UNITED ARAB EMIRATES' WHEN n IN ('FRANCAISE', 'FRANCAIS') THEN 'FRANCE' WHEN n IN ('RUSSE', 'RUSSO') THEN 'RUSSIAN FEDERATION' WHEN n = 'EMIRATS ARABES UNIS' THEN 'UNITED ARAB EMIRATES' ELSE n END WHEN 'surname' THEN n ELSE v END AS value FROM b""")
def normalised_fields(spark, sf_dir):
    return derive(spark, sf_dir, _FIELDS).select("id", "key", evaluation.by_field(F.col("key"), F.col("value"), {"ARE": "UNITED ARAB EMIRATES"}).alias("value"))


_GUESSES = """SELECT l_orderkey AS id, l_linenumber AS n, CASE l_partkey % 4 WHEN 0 THEN 'iban' WHEN 1 THEN 'total_vat' WHEN 2 THEN 'seller' ELSE 'invoice_date' END AS key,
  CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 4 = 0 THEN concat('DE ', CAST(l_partkey AS STRING)) WHEN l_partkey % 4 = 1 THEN concat('$ ', CAST(l_partkey % 7 AS STRING), '.200,00') WHEN l_partkey % 4 = 2 THEN concat('Big Shop Ltd S', CAST(l_partkey % 11 AS STRING)) ELSE concat('03/0', CAST(l_partkey % 9 + 1 AS STRING), '/2020') END AS truth,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_partkey % 4 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN concat('de', CAST(l_partkey AS STRING)) ELSE 'none' END WHEN l_partkey % 4 = 1 THEN CASE WHEN l_suppkey % 3 = 0 THEN 'n/a' WHEN l_suppkey % 2 = 0 THEN concat(CAST(l_suppkey % 7 AS STRING), '.150,00') ELSE concat(CAST(l_partkey % 7 AS STRING), '200,00') END
  WHEN l_partkey % 4 = 2 THEN concat(CASE WHEN l_suppkey % 2 = 0 THEN ' big  SHOP ' ELSE 'BIG shop ltd ' END, 's', CAST(l_suppkey % 11 AS STRING)) ELSE concat('03.', CAST(l_suppkey % 9 + 1 AS STRING), CASE WHEN l_suppkey % 2 = 0 THEN '.2021' ELSE '-2020' END) END AS guess, l_suppkey % 2 = 0 AS even FROM lineitem"""


_DIGITS = "regexp_replace(coalesce({c}, ''), '[^0-9]', '', 'g')"
_AMOUNT = "TRY_CAST(replace(regexp_replace(lower(trim({c})), '[$ .]', '', 'g'), ',', '.') AS DOUBLE)"
_WORDS = r"list_distinct([x for x in string_split(trim(regexp_replace(lower({c}), '\s+', ' ', 'g')), ' ') if x <> ''])"
_GROUPS = "regexp_extract_all({c}, '[0-9]{{1,4}}')"


@query(rf"""WITH g AS (SELECT id, n, key, truth, guess, {_DIGITS.format(c='truth')} AS dt, {_DIGITS.format(c='guess')} AS dg, {_AMOUNT.format(c='truth')} AS a_t, {_AMOUNT.format(c='guess')} AS a_g, {_WORDS.format(c='truth')} AS wt, {_WORDS.format(c='guess')} AS wg, {_GROUPS.format(c='truth')} AS gt, {_GROUPS.format(c='guess')} AS gg FROM ({_GUESSES}))
SELECT id, n, round(CASE WHEN truth IS NULL THEN NULL WHEN guess IS NULL THEN 0.0 WHEN key = 'iban' THEN CASE WHEN dt <> '' AND dt = dg THEN 1.0 ELSE 0.0 END WHEN key = 'total_vat' THEN CASE WHEN a_t IS NULL OR a_g IS NULL THEN 0.0 WHEN a_t = 0 THEN CAST(a_g = 0 AS INT) ELSE greatest(0.0, 1 - abs(a_g - a_t) / abs(a_t)) END
WHEN key = 'seller' THEN 2.0 * len(list_intersect(wt, wg)) / (len(wt) + len(wg)) ELSE (CAST(gt[1] = gg[1] AS INT) + CAST(gt[2] = gg[2] AS INT) + CAST(gt[3] = gg[3] AS INT)) / 3.0 END, 6) AS soft,
CASE WHEN truth IS NOT NULL THEN CASE WHEN CASE WHEN key = 'total_vat' THEN a_t IS NOT DISTINCT FROM a_g ELSE trim(regexp_replace(lower(truth), '\s+', ' ', 'g')) IS NOT DISTINCT FROM trim(regexp_replace(lower(guess), '\s+', ' ', 'g')) END THEN 'yes' ELSE 'no' END END AS exact FROM g""")
def field_scores(spark, sf_dir):
    k, p, t = F.col("key"), F.col("guess"), F.col("truth")
    return derive(spark, sf_dir, _GUESSES).select("id", "n", F.round(evaluation.soft_score(k, p, t), 6).alias("soft"), F.when(t.isNotNull(), F.when(evaluation.exact_match(k, p, t), "yes").otherwise("no")).alias("exact"))


_RESULTS = """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '{"mode": "passport_mrz"}' WHEN 1 THEN '{"mode": "heuristic"}' END AS raw, CASE o_orderkey % 4 WHEN 0 THEN '{"validation": {"is_valid": true}}' WHEN 1 THEN '{"validation": {"is_valid": false}}' WHEN 2 THEN '{"x": 1}' END AS result,
  o_orderdate AS began, o_orderkey AS ms, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 1000) / 1000.0 END AS share FROM orders"""


@query(f"SELECT id, id % 3 = 0 AS is_zone, id % 4 = 0 AS valid, ms, CASE WHEN id % 5 = 0 THEN '—' ELSE concat(CAST(CAST(floor((id % 1000) / 10.0 + 0.5) AS INT) AS STRING), '%') END AS share, concat('None,', CAST(id AS STRING)) AS joined FROM ({_RESULTS})")
def job_flags(spark, sf_dir):
    c = F.col
    r = derive(spark, sf_dir, _RESULTS)
    began = c("began").cast("timestamp")
    ended = F.timestamp_micros(F.unix_micros(began) + c("ms") * 1000)
    # thousandths are whole here, so that the halves that decide are exact
    return r.select("id", evaluation.is_zone_job(c("raw")).alias("is_zone"), evaluation.zone_valid(c("result")).alias("valid"), evaluation.elapsed_ms(began, ended).alias("ms"), evaluation.percent(F.when(c("id") % 5 != 0, (c("id") % 1000).cast("decimal(10,0)") / 1000)).alias("share"), evaluation.joined(F.array(F.lit(None).cast("string"), c("id").cast("string"))).alias("joined"))


_METADATA = "SELECT c_nationkey AS repo, c_custkey AS index, CASE WHEN c_custkey % 5 = 0 THEN 'Female' WHEN c_custkey % 5 = 1 THEN 'x' END AS gender, CASE c_custkey % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'X/F' END AS sex FROM customer"
_PICTURES = "SELECT p_partkey % 30 AS repo, concat('p', lpad(CAST(p_partkey AS STRING), 7, '0'), CASE WHEN p_size % 2 = 0 THEN '.jpg' ELSE '.png' END) AS path, CASE WHEN p_partkey % 30 = 3 THEN 'male' WHEN p_partkey % 30 = 4 THEN 'other' WHEN p_partkey % 30 = 5 AND p_size % 3 = 0 THEN 'female' WHEN p_size % 3 = 0 THEN 'male' WHEN p_size % 3 = 1 THEN 'female' ELSE 'other' END AS bucket FROM part"


@query(f"""WITH m AS (SELECT repo, index, CASE WHEN lower(gender) IN ('male', 'female') THEN lower(gender) WHEN upper(sex) LIKE 'M%' OR upper(sex) LIKE '%/M%' THEN 'male' WHEN upper(sex) LIKE 'F%' OR upper(sex) LIKE '%/F%' THEN 'female' WHEN index % 2 = 0 THEN 'male' ELSE 'female' END AS bucket FROM ({_METADATA})),
pic AS ({_PICTURES}), n AS (SELECT repo, count(*) FILTER (WHERE bucket = 'male') AS male, count(*) FILTER (WHERE bucket = 'female') AS female, count(*) FILTER (WHERE bucket = 'other') AS other, count(*) AS everything FROM pic GROUP BY repo),
pool AS (SELECT repo, path, bucket, row_number() OVER (PARTITION BY repo, bucket ORDER BY path) - 1 AS k FROM pic UNION ALL SELECT repo, path, 'all', row_number() OVER (PARTITION BY repo ORDER BY right(path, 3), path) - 1 FROM pic),
a AS (SELECT m.*, coalesce(male, 0) AS male, coalesce(female, 0) AS female, coalesce(other, 0) AS other, coalesce(everything, 0) AS everything, row_number() OVER (PARTITION BY m.repo, bucket ORDER BY index) - 1 AS r FROM m LEFT JOIN n ON m.repo = n.repo),
b AS (SELECT *, CASE bucket WHEN 'male' THEN male ELSE female END AS own FROM a), c AS (SELECT *, r < CASE WHEN own > 0 THEN own ELSE other END AS direct FROM b),
d AS (SELECT *, sum(CASE WHEN direct THEN 0 ELSE 1 END) OVER (PARTITION BY repo ORDER BY index) - 1 AS o FROM c),
e AS (SELECT *, min(CASE WHEN NOT direct AND o >= CASE WHEN other > 0 THEN other ELSE everything END THEN index END) OVER (PARTITION BY repo) AS stop FROM d)
SELECT e.repo, e.index, e.bucket, pool.path AS image FROM e JOIN pool ON pool.repo = e.repo AND pool.bucket = CASE WHEN direct THEN CASE WHEN own > 0 THEN e.bucket ELSE 'other' END WHEN other > 0 THEN 'other' ELSE 'all' END AND pool.k = CASE WHEN direct THEN r ELSE o END WHERE stop IS NULL OR e.index < stop""")
def zipped_images(spark, sf_dir):
    m = derive(spark, sf_dir, _METADATA)
    return imports.zipped(m.select("repo", "index", imports.gender_bucket(F.col("gender"), F.col("sex"), F.col("index")).alias("bucket")), derive(spark, sf_dir, _PICTURES))


_PATHS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 5 THEN concat('E:/old//img/', CAST(c_custkey AS STRING)) WHEN c_custkey % 9 = 6 THEN concat('/kaggle/img/', CAST(c_custkey AS STRING)) WHEN c_custkey % 9 = 7 THEN concat('E:/old/data/multidoc/', CAST(c_custkey AS STRING)) WHEN c_custkey % 9 = 8 THEN concat('E:', chr(92), 'old', chr(92), 'img', chr(92), CAST(c_custkey AS STRING)) WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN concat('root/img/', CAST(c_custkey AS STRING)) WHEN c_custkey % 5 = 2 THEN concat('E:/old/img/', CAST(c_custkey AS STRING)) WHEN c_custkey % 5 = 3 THEN concat('q/data/multidoc/', CAST(c_custkey AS STRING)) ELSE 'gone' END AS image_path FROM customer"
_LISTING = "SELECT concat('root/img/', CAST(c_custkey AS STRING)) AS path FROM customer WHERE c_custkey % 4 < 2 UNION ALL SELECT concat('root/data/multidoc/', CAST(c_custkey AS STRING)) FROM customer WHERE c_custkey % 2 = 0"


@query(rf"""WITH p AS (SELECT id, image_path, replace(image_path, chr(92), '/') AS x FROM ({_PATHS})), t AS (SELECT id, unnest([image_path, CASE WHEN starts_with(x, 'E:/old/') THEN concat('root/', ltrim(substr(x, 8), '/')) END, CASE WHEN starts_with(x, '/kaggle/') THEN concat('root/', ltrim(substr(x, 9), '/')) END, CASE WHEN contains(x, 'data/multidoc/') THEN concat('root/data/multidoc/', substr(x, instr(x, 'data/multidoc/') + 14)) END]) AS c, unnest([1, 2, 3, 4]) AS r FROM p),
b AS (SELECT id, arg_min(c, r) AS c FROM t WHERE c IN (SELECT path FROM ({_LISTING})) GROUP BY id) SELECT p.id AS id, coalesce(b.c, image_path) AS image_path FROM p LEFT JOIN b ON b.id = p.id""")
def remapped_paths(spark, sf_dir):
    return imports.remapped(derive(spark, sf_dir, _PATHS), derive(spark, sf_dir, _LISTING), "root", ("E:/old/", "/kaggle/"))


@query(f"""WITH d AS ({DATASET}), base AS (SELECT * FROM d WHERE file_no = 1), more AS (SELECT * FROM d WHERE file_no = 2 OR line_no % 2 = 0)
SELECT id, line_no FROM base WHERE id IS NULL OR id NOT IN ('3', '5') UNION ALL SELECT id, line_no FROM more WHERE (id IS NULL OR id NOT IN (SELECT id FROM base WHERE id IS NOT NULL)) AND (id IS NULL OR id NOT IN ('3', '5'))""")
def curriculum_additions(spark, sf_dir):
    d = derive(spark, sf_dir, DATASET)
    return imports.additions(d.where("file_no = 1"), d.where("file_no = 2 or line_no % 2 = 0"), without=("3", "5")).select("id", "line_no")


@query(f"WITH d AS ({DATASET}), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_no, line_no) AS r FROM d) SELECT id, file_no, line_no FROM k WHERE r = 1 OR id = '' OR id IS NULL ORDER BY file_no, line_no LIMIT 900")
def load_rows(spark, sf_dir):
    return imports.load_rows(derive(spark, sf_dir, DATASET), 900).select("id", "file_no", "line_no")


@query("SELECT concat('acme__id-set-', lpad(CAST(c_custkey AS STRING), CAST(greatest(3, length(CAST(c_custkey AS STRING))) AS INT), '0')) AS id, 'id_card' AS document_type, 'needs_annotation_external' AS status FROM customer WHERE c_custkey < 700 AND c_custkey % 7 <> 0")
def external_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"))
    known = c.where("pos % 7 = 0").select(F.format_string("acme__id-set-%03d", "pos").alias("id"))
    return imports.external_rows(c, known, ("surname", "address"), "id_card", "acme/id set", 700).select("id", "document_type", "status")


_NESTED = """SELECT c_custkey AS id, concat('{"documents": [{"_id": "a', CAST(c_custkey AS STRING), '", "filename": "', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('f', CAST(c_custkey AS STRING), '.x.png') END, '", "annotations": [', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('{"template": "t', CAST(c_custkey % 2 AS STRING), '", "fields": {"name": "', c_name, '"}}, {"template": "no"}') END,
  ']}, {"filename": "g', CAST(c_custkey AS STRING), '.png", "annotations": [{}]}, {"filename": "h.png"}]}') AS value FROM customer"""


_STEM = r"regexp_replace(regexp_extract(f, '[^/]*$'), '\.[^.]*$', '')"


@query(rf"""WITH v AS ({_NESTED}), d AS (SELECT unnest(CAST(json_extract(CAST(value AS JSON), '$.documents[*]') AS JSON[])) AS d FROM v), a AS (SELECT d, json_extract_string(d, '$.filename') AS f, json_extract(d, '$.annotations[0]') AS one FROM d),
l AS (SELECT concat('img/f', CAST(c_custkey AS VARCHAR), '.x.png') AS path FROM customer UNION SELECT concat('img/g', CAST(c_custkey AS VARCHAR), '.png') FROM customer WHERE c_custkey % 5 <> 0)
SELECT concat('docxpand_', coalesce(json_extract_string(d, '$._id'), json_extract_string(d, '$.id'), {_STEM})) AS id, concat('img/', f) AS image_path, coalesce(nullif(json_extract_string(one, '$.template'), ''), 'unknown') AS template, json_extract_string(one, '$.fields.name') AS name FROM a WHERE one IS NOT NULL AND coalesce(f, '') <> '' AND concat('img/', f) IN (SELECT path FROM l)""")
def nested_documents(spark, sf_dir):
    c = F.col("c_custkey").cast("string")
    customer = table(spark, sf_dir, "customer")
    listing = customer.select(F.concat(F.lit("img/f"), c, F.lit(".x.png")).alias("path")).unionByName(customer.where("c_custkey % 5 <> 0").select(F.concat(F.lit("img/g"), c, F.lit(".png")).alias("path")))
    return imports.nested_documents(derive(spark, sf_dir, _NESTED), listing, "img").select("id", "image_path", "template", F.try_element_at("fields", F.lit("name")).alias("name"))


#: Label lines of images: both forms of a record, blank lines within zones, repeated images, and dictionaries of two images in one object.
LABELS = """SELECT c_custkey AS n, replace(CASE c_custkey % 7 WHEN 0 THEN concat('{"image": "i', CAST(c_custkey AS STRING), '", "line1": "A', c_mktsegment, '", "line2": "B"}') WHEN 1 THEN '' WHEN 2 THEN concat('{"image": "i', CAST(c_custkey AS STRING), '", "mrz": "', c_mktsegment, '~n~n  ~nB', CAST(c_nationkey AS STRING), '", "line1": "no"}')
  WHEN 3 THEN concat('{"i', CAST(c_custkey AS STRING), '": "', c_mktsegment, '~r~nC", "i', CAST(c_custkey + 1 AS STRING), '": "D"}') WHEN 4 THEN concat('{"image": "i', CAST(c_custkey - 2 AS STRING), '", "line1": "again', CAST(c_custkey AS STRING), '"}') WHEN 5 THEN concat('{"image": "i', CAST(c_custkey AS STRING), '", "mrz": "~n"}') ELSE '  ' END, '~', chr(92)) AS value FROM customer"""
SIDES = "SELECT concat('i', CAST(c_custkey AS STRING)) AS image, concat('S', c_mktsegment) AS line1, 'S2' AS line2 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT concat('i', CAST(c_custkey AS STRING)), 'R1', '' FROM customer WHERE c_custkey % 4 = 0"


@query(f"""WITH l AS ({LABELS}), j AS (SELECT n, CAST(value AS JSON) AS j FROM l WHERE trim(value) <> ''), k AS (SELECT n, j, unnest(json_keys(j)) AS k, generate_subscripts(json_keys(j), 1) AS pos FROM j WHERE NOT list_contains(json_keys(j), 'image')),
raw AS (SELECT n, 0 AS pos, json_extract_string(j, '$.image') AS image, CASE WHEN list_contains(json_keys(j), 'mrz') THEN json_extract_string(j, '$.mrz') END AS mrz, json_extract_string(j, '$.line1') AS line1, json_extract_string(j, '$.line2') AS line2 FROM j WHERE list_contains(json_keys(j), 'image') UNION ALL SELECT n, pos, k, json_extract_string(j, concat('$.', k)), NULL, NULL FROM k),
two AS (SELECT n, pos, image, line1, line2, mrz, [x for x in string_split(replace(mrz, chr(13), ''), chr(10)) if trim(x) <> ''] AS p FROM raw),
f AS (SELECT n, pos, image, coalesce(CASE WHEN mrz IS NULL THEN line1 ELSE p[1] END, '') AS line1, coalesce(CASE WHEN mrz IS NULL THEN line2 ELSE p[2] END, '') AS line2 FROM two), t AS (SELECT image, arg_max(line1, (n, pos)) AS line1, arg_max(line2, (n, pos)) AS line2 FROM f GROUP BY image),
s AS (SELECT image, max({{'a': line1, 'b': line2}}) AS x FROM ({SIDES}) GROUP BY image)
SELECT c_custkey AS id, CASE WHEN t.image IS NOT NULL THEN t.line1 ELSE x.a END AS line1, CASE WHEN t.image IS NOT NULL THEN t.line2 ELSE x.b END AS line2 FROM customer LEFT JOIN t ON t.image = concat('i', CAST(c_custkey AS STRING)) LEFT JOIN s ON s.image = concat('i', CAST(c_custkey AS STRING)) WHERE t.image IS NOT NULL OR s.image IS NOT NULL""")
def labelled_images(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("i"), F.col("c_custkey").cast("string")).alias("image"))
    return imports.with_truth(rows, imports.labels(derive(spark, sf_dir, LABELS), "n"), derive(spark, sf_dir, SIDES)).select("id", "line1", "line2")


@query("SELECT page_id AS id, CASE WHEN page_id % 3 = 2 THEN NULL WHEN page_id % 3 = 1 AND octet_length(encode(html)) % 2 = 1 THEN NULL ELSE CAST(octet_length(encode(html)) AS STRING) END AS text, CASE WHEN page_id % 3 = 2 THEN 'engine none isn''t implemented' WHEN page_id % 3 = 1 AND octet_length(encode(html)) % 2 = 1 THEN 'odd' END AS error FROM pages")
def engine_results(spark, sf_dir):
    """Three engines that are passed in: a stub, one that fails for some rows, and one that isn't implemented."""

    def stub(raw: bytes) -> str:
        return str(len(raw))

    def picky(raw: bytes) -> str:
        if len(raw) % 2:
            raise ValueError("odd")
        return stub(raw)

    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").cast("binary").alias("content"))
    runs = [imports.run_engine(p.where(f"id % 3 = {k}"), f) for k, f in enumerate((stub, picky, imports.unimplemented("none")))]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).select("id", "text", "error")


@query(f"WITH d AS ({DATASET}) SELECT id, line_no FROM d WHERE id IS NULL OR id NOT IN (SELECT CAST(doc_id AS STRING) FROM labels WHERE doc_id IS NOT NULL) ORDER BY line_no LIMIT 300")
def unfinished_rows(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return imports.unfinished(derive(spark, sf_dir, DATASET), done, 300).select("id", "line_no")


# reports


@query(f"WITH d AS ({DATASET}) SELECT 'holdout' AS eval_set, id, line_no, CAST(bootstrap_template AS VARCHAR) AS template FROM d WHERE file_no = 1 UNION ALL SELECT 'holdout', id, line_no, NULL FROM d WHERE file_no = 2 UNION ALL SELECT 'cross', id, line_no, NULL FROM d WHERE file_no = 2")
def eval_sets(spark, sf_dir):
    d = derive(spark, sf_dir, DATASET).select("id", "file_no", "line_no", "bootstrap_template")
    one, two = d.where("file_no = 1"), d.where("file_no = 2").drop("bootstrap_template")
    return reports.eval_sets({"holdout": [one, two], "cross": [two]}).select("eval_set", "id", "line_no", F.col("bootstrap_template").cast("string").alias("template"))


@query(f"SELECT id, line_no, CASE WHEN id IN ('7', '11', '') THEN 'val' ELSE 'train' END AS split FROM ({DATASET})")
def constant_split(spark, sf_dir):
    return reports.constant_split(derive(spark, sf_dir, DATASET), ("7", "11", "")).select("id", "line_no", "split")


@query(f"SELECT id, owner, created_at FROM ({JOBS}) WHERE status = 'queued' ORDER BY created_at, id LIMIT 3")
def queue_head(spark, sf_dir):
    return reports.queue_head(derive(spark, sf_dir, JOBS), n=3).select("id", "owner", "created_at")


@query(f"WITH {_SCORES}, x AS (SELECT a.id, b.f1_score - a.f1_score AS delta FROM s a JOIN s b ON a.id = b.id WHERE a.engine = 'heuristic' AND b.engine = 'tuned') SELECT * FROM (SELECT id, delta, 'best' AS \"end\" FROM x ORDER BY delta DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT id, delta, 'worst' FROM x ORDER BY delta, id LIMIT 10)")
def both_ends(spark, sf_dir):
    return reports.both_ends(metrics.compare_runs(metrics.per_document(*fields(spark, sf_dir)), "heuristic", "tuned").select("id", "delta"))


_NORMAL = "upper(replace(value, 'x', ''))"


@query(f"""WITH e AS ({EXPECTED}), p AS ({PREDICTED}), g AS (SELECT DISTINCT engine FROM p), n AS (SELECT count(DISTINCT id) AS n FROM e),
fe AS (SELECT 'exact' AS family, id, key, value FROM e UNION ALL SELECT 'normalised', id, key, {_NORMAL} FROM e UNION ALL SELECT 'derivable', id, key, {_NORMAL} FROM e WHERE key IN ('code', 'extra')),
fp AS (SELECT 'exact' AS family, engine, id, key, value FROM p UNION ALL SELECT 'normalised', engine, id, key, {_NORMAL} FROM p UNION ALL SELECT 'derivable', engine, id, key, {_NORMAL} FROM p WHERE key IN ('code', 'extra')),
d AS (SELECT f.family, g.engine, i.id FROM (SELECT DISTINCT family FROM fe) f, g, (SELECT DISTINCT id FROM e) i), ne AS (SELECT family, id, count(value) AS ne FROM fe GROUP BY ALL), np AS (SELECT family, engine, id, count(value) AS np FROM fp GROUP BY ALL),
tp AS (SELECT fp.family, fp.engine, fp.id, count(*) AS tp FROM fp JOIN fe ON fe.family = fp.family AND fe.id = fp.id AND fe.key = fp.key AND fe.value = fp.value GROUP BY ALL),
m AS (SELECT d.*, coalesce(tp, 0) / nullif(coalesce(np, 0), 0) AS pr, coalesce(tp, 0) / nullif(coalesce(ne, 0), 0) AS re FROM d LEFT JOIN ne ON ne.family = d.family AND ne.id = d.id LEFT JOIN np ON np.family = d.family AND np.engine = d.engine AND np.id = d.id LEFT JOIN tp ON tp.family = d.family AND tp.engine = d.engine AND tp.id = d.id),
x AS (SELECT family, engine, coalesce(pr, 0) AS pr, coalesce(re, 0) AS re FROM m)
SELECT engine, family, count(*) AS n, round(avg(re), 9) AS field_accuracy, round(avg(pr), 9) AS precision, round(avg(re), 9) AS recall, round(avg(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END), 9) AS f1_score FROM x GROUP BY engine, family""")
def metric_families(spark, sf_dir):
    found = reports.families(*fields(spark, sf_dir), lambda k, v: F.upper(F.replace(v, F.lit("x"), F.lit(""))), ("code", "extra"))
    return found.select("engine", "family", "n", *(F.round(c, 9).alias(c) for c in ("field_accuracy", "precision", "recall", "f1_score")))


@query("SELECT coalesce(round_even(avg(l_quantity), 4), 0) AS quantity, coalesce(round_even(avg(CASE WHEN l_linenumber = 1 THEN 1.0 ELSE 0.0 END), 4), 0) AS line1_exact, count(*) AS n FROM lineitem")
def recognition_means(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), (F.col("l_linenumber") == 1).alias("line1_exact"))
    return reports.recognition_means(rows, ("quantity", "line1_exact"))


_HISTORY = "SELECT o_custkey AS run, o_orderkey AS epoch, CAST(o_custkey * 31 + o_orderkey * 7919 AS BIGINT) % 13 AS loss FROM orders"


@query(f"""WITH h AS (SELECT *, row_number() OVER w AS n, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM ({_HISTORY}) WINDOW w AS (PARTITION BY run ORDER BY epoch)),
l AS (SELECT *, max(CASE WHEN low IS NULL OR loss < low THEN n END) OVER (PARTITION BY run ORDER BY epoch) AS last FROM h), s AS (SELECT *, min(CASE WHEN n - last >= 3 THEN epoch END) OVER (PARTITION BY run) AS stopped FROM l)
SELECT run, arg_min(epoch, (loss, epoch)) AS epoch, min(loss) AS loss, min(stopped) AS stopped FROM s WHERE stopped IS NULL OR epoch <= stopped GROUP BY run""")
def best_epoch(spark, sf_dir):
    return reports.best_epoch(derive(spark, sf_dir, _HISTORY))


_FLAGS = "SELECT source AS source_dataset, CASE WHEN source LIKE '%1%' THEN 'one' ELSE 'more' END AS flag FROM documents WHERE doc_id % 3 = 0"


@query(f"WITH f AS (SELECT DISTINCT * FROM ({_FLAGS})) SELECT d.file_no AS version, coalesce(flag, 'none') AS flag, count(*) AS n FROM ({DATASET}) d LEFT JOIN f ON d.source_dataset = f.source_dataset GROUP BY ALL")
def version_composition(spark, sf_dir):
    return reports.composition(derive(spark, sf_dir, DATASET).withColumnRenamed("file_no", "version"), derive(spark, sf_dir, _FLAGS))


@query("SELECT DISTINCT concat(a, k, '>') AS token FROM (SELECT c_mktsegment AS k FROM customer UNION ALL SELECT 'id') CROSS JOIN (SELECT '<s_' AS a UNION ALL SELECT '</s_')")
def tag_vocabulary(spark, sf_dir):
    return reports.tag_vocabulary(table(spark, sf_dir, "customer").select(F.create_map(F.col("c_mktsegment"), "c_name", F.lit("id"), F.col("c_custkey").cast("string")).alias("fields")))
