"""Queries of identity records and tolerant zone readers, each with the same result as SQL that works on the derived text."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import licence, passport, text, zonetext
from scriptorium.operators import identity
from scriptorium.plans.fixtures import PERSONS, derive
from scriptorium.plans.queries import query

# pieces of SQL

_NAMED_DATE = r"\b[0-9]{2}\s+[A-Z][a-z]{2}\s+[0-9]{4}\b"
_ANY_DATE = r"\b(?:[0-9]{2}[./-][0-9]{2}[./-][0-9]{2,4}|[0-9]{2}\s+[A-Z][a-z]{2}\s+[0-9]{4})\b"


def _lines(c: str) -> str:
    return f"[trim(x) for x in string_split({c}, chr(10)) if trim(x) <> '']"


def _after(ls: str, *markers: str) -> str:
    return f"{ls}[list_min([i for i in range(1, len({ls})) if regexp_matches(upper({ls}[i]), '{'|'.join(markers)}')]) + 1]"


def _line(ls: str, *markers: str) -> str:
    return f"[x for x in {ls} if regexp_matches(upper(x), '{'|'.join(markers)}')][1]"


def _beside(ls: str, *markers: str) -> str:
    one = "coalesce(" + ", ".join(f"CASE WHEN contains(upper({ls}[i]), '{m}') THEN coalesce(nullif(trim(substr({ls}[i], instr(upper({ls}[i]), '{m}') + {len(m)}), ' :-'), ''), {ls}[i + 1]) END" for m in markers) + ", NULL)"
    return f"[y for y in [{one} for i in range(1, len({ls}) + 1)] if y IS NOT NULL][1]"


_BAD_BEFORE = "UNITED STATES|PASSPORT|GIVEN NAMES|NATIONALITY|DATE OF|SIGNATURE|TYPE /|PLACE|SEE PAGE"


def _before(ls: str) -> str:
    """The nearest good line before the first GIVEN NAMES that has one."""
    good = f"[j for j in range(1, i) if length({ls}[j]) > 1 AND NOT regexp_matches({ls}[j], '[0-9]') AND NOT regexp_matches(upper({ls}[j]), '{_BAD_BEFORE}')]"
    return f"{ls}[[m for m in [list_max({good}) for i in range(1, len({ls}) + 1) if contains(upper({ls}[i]), 'GIVEN NAMES')] if m IS NOT NULL][1]]"


def _zone_parts(t: str) -> str:
    """CTEs zl to zp: the service's reading of texts (id, k, t)."""
    name = lambda x: f"nullif(trim(replace({x}, '<', ' ')), '')"
    date = lambda i: f"CASE WHEN regexp_full_match(replace(substr(l2, {i}, 6), '<', ''), '[0-9]{{6}}') THEN concat(substr(l2, {i + 4}, 2), '.', substr(l2, {i + 2}, 2), '.', CASE WHEN CAST(substr(l2, {i}, 2) AS INT) >= 30 THEN '19' ELSE '20' END, substr(l2, {i}, 2)) END"
    plain = lambda i, n: f"nullif(replace(substr(l2, {i}, {n}), '<', ''), '')"
    fields = {"surname": f"CASE WHEN p > 0 THEN {name('substr(part, 1, p - 1)')} END", "given_names": f"CASE WHEN p > 0 THEN {name('substr(part, p + 2)')} END"}
    fields |= {k: f"CASE WHEN ok THEN {v} END" for k, v in {"nationality": plain(11, 3), "date_of_birth": date(14), "sex": plain(21, 1), "date_of_expiry": date(22), "document_number": plain(1, 9)}.items()}
    return rf"""zl AS (SELECT id, k, [x for x in [regexp_replace(upper(y), '[^A-Z0-9<]', '', 'g') for y in string_split({t}.t, chr(10))] if x <> ''] AS zs FROM {t} WHERE {t}.t IS NOT NULL),
zj AS (SELECT *, array_to_string(zs, '') AS joined, regexp_extract(array_to_string(zs, ''), 'P<[A-Z<]{{20,}}') AS cand FROM zl WHERE len(zs) > 0),
zt AS (SELECT id, k, rpad(substr(CASE WHEN cand <> '' THEN cand ELSE zs[1] END, 1, 44), 44, '<') AS l1, CASE WHEN len(zs) >= 2 THEN rpad(substr(zs[2], 1, 44), 44, '<') WHEN cand <> '' AND length(joined) >= instr(joined, cand) + length(cand) THEN rpad(substr(substr(joined, instr(joined, cand) + length(cand)), 1, 44), 44, '<') END AS l2 FROM zj),
zq AS (SELECT *, CASE WHEN regexp_matches(l1, '^P<[A-Z]{{3}}[A-Z<]*<<') THEN substr(l1, 6) ELSE substr(l1, 3) END AS part, coalesce(length(replace(l2, '<', '')) >= 20 AND regexp_matches(l2, '^[A-Z0-9<]{{9}}[0-9][A-Z]{{3}}[0-9]{{6}}[MFX<][0-9]{{6}}'), false) AS ok FROM zt WHERE starts_with(l1, 'P<')),
zp AS (SELECT id, k, {', '.join(f'{v} AS {f}' for f, v in fields.items())} FROM (SELECT *, instr(part, '<<') AS p FROM zq))"""


_ZONED = ("surname", "given_names", "nationality", "date_of_birth", "sex", "date_of_expiry", "document_number")

#: Passport pages of customers: labels, dates, compact lines and zones come and go and contradict each other.
PASSPORTS = """
SELECT c_custkey AS id, concat_ws(chr(10), CASE c_custkey % 3 WHEN 0 THEN 'Passport  Type P' WHEN 1 THEN 'the United Arab Emirates' ELSE 'UNITED STATES OF AMERICA' END,
    CASE c_custkey % 5 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'Lee' WHEN 2 THEN 'USAFARSI' WHEN 3 THEN 'Holder 12' ELSE concat('Mc', lower(c_mktsegment), '-Ray') END,
    CASE WHEN c_custkey % 4 < 3 THEN concat('Given names / Prenoms', CASE WHEN c_custkey % 8 = 1 THEN ' 2' ELSE '' END) END, CASE c_custkey % 7 WHEN 0 THEN 'ANNA, MARIA date' WHEN 1 THEN 'USAF' WHEN 2 THEN 'Issue' ELSE concat('Lou ', lower(c_mktsegment)) END,
    CASE WHEN c_custkey % 7 < 4 THEN 'Nationality' END, CASE WHEN c_custkey % 11 < 6 THEN concat('N', CAST(c_nationkey AS STRING)) END,
    CASE WHEN c_custkey % 6 = 1 THEN 'Date of birth' END, CASE c_custkey % 13 WHEN 0 THEN '12 Mar 1974 05 Jun 2019 x 04 Jul 2029' WHEN 1 THEN '01 Feb 1980, 02 Mar 2020' WHEN 2 THEN '03 Apr 1991' WHEN 3 THEN 'none' ELSE concat(lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0'), ' Oct 1970') END,
    CASE WHEN c_custkey % 9 = 2 THEN 'Date of issue' END, CASE WHEN c_custkey % 9 = 5 THEN 'DATE OF EXPIRATION' END, CASE WHEN c_custkey % 2 = 0 THEN concat('on ', lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0'), ' Nov 2031') END,
    CASE WHEN c_custkey % 5 < 2 THEN 'Lieu de naissance' END, CASE WHEN c_custkey % 10 < 5 THEN 'CHICAGO ILINIOIS' ELSE concat('Town ', CAST(c_nationkey AS STRING)) END,
    CASE WHEN c_custkey % 8 < 3 THEN concat('no ', lpad(CAST(c_custkey AS STRING), 8, '0'), ' and 12345678 ', CASE WHEN c_custkey % 16 < 8 THEN lpad(CAST(c_custkey AS STRING), 8, '0') ELSE '' END) END,
    CASE WHEN c_custkey % 12 = 3 THEN concat('AB', lpad(CAST(c_custkey AS STRING), 6, '0'), ' UTO 12 03 1974 f 15.04.2031') WHEN c_custkey % 12 = 7 THEN concat('AB', lpad(CAST(c_custkey AS STRING), 6, '0'), '6UTO7408122F1204159ZE') END,
    CASE WHEN c_custkey % 15 = 4 THEN 'issued by the Authority of Nowhere' END,
    CASE WHEN c_custkey % 10 = 3 THEN concat('P<UTO', c_mktsegment, '<<ANNA<MARIA<<<<<<<<<<<<') END, CASE WHEN c_custkey % 20 = 3 THEN concat('L', lpad(CAST(c_custkey AS STRING), 8, '0'), '6UTO740812F1204159<<<<<<<<') END) AS said,
  CASE c_custkey % 7 WHEN 1 THEN concat('P<UTO', c_mktsegment, 'S<<EVA<LOU<<<<<<<<<<<<<<<<', chr(10), 'K', lpad(CAST(c_custkey AS STRING), 8, '0'), '1RUS800101M3001012<<<<<') WHEN 2 THEN concat('P<AL<', c_mktsegment, '<<OMAR<<<<<<<<<<<<<<') WHEN 3 THEN 'P<UTOX' WHEN 4 THEN ' ' WHEN 5 THEN concat('p<gbr', lower(c_mktsegment), '<<<<<<<<<<<<<<<<<<<<<<', lpad(CAST(c_custkey AS STRING), 9, '0'), '7GBR910203<2501014<<') END AS zone,
  CASE c_custkey % 6 WHEN 0 THEN concat('Name', chr(10), 'Jo-Ann / Lou  ', lower(c_mktsegment), ' 7') WHEN 1 THEN concat(upper(c_mktsegment), chr(10), 'GIVEN NAMES', chr(10), 'Petra') WHEN 2 THEN 'Country Code' END AS names,
  CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Sex: m ' WHEN 2 THEN 'type F x' WHEN 3 THEN '(x)' END AS sex,
  CASE c_custkey % 8 WHEN 0 THEN concat('Issuing  Authority:', chr(10), ' MOI 04/05/2018') WHEN 1 THEN 'Authority' WHEN 2 THEN 'x AUTORIDAD United States Department of State, y' WHEN 3 THEN concat('Autorit. / PARIS ', CAST(c_nationkey AS STRING), ' F') WHEN 4 THEN ' : ' END AS authority FROM customer"""

_USEFUL = "nullif(trim(regexp_replace({v}, '[^A-Z ]', '', 'g')), '') NOT IN ('NO', 'OF', 'ISSUE', 'DATE OF', 'DATE', 'BIRTH', 'PLACE', 'PASSPORT', 'AUTHORITY', 'UNITED')"
_SURNAME = "CASE WHEN x = 'FARSI' THEN 'AL FARSI' ELSE x END"


def _passport_sql() -> str:
    name = lambda x: f"nullif(trim(replace({x}, '<', ' ')), '')"
    compact = lambda p, i: f"regexp_extract(squashed, '{p}', {i})"
    long_, short = "([A-Z0-9]{8,9})([A-Z]{3})([0-9]{8})([MFX])([0-9]{8})", "([A-Z0-9]{8,9})[0-9]([A-Z]{3})([0-9]{6})[0-9]([MFX])([0-9]{6})"
    slashed = lambda i: f"concat(substr({compact(long_, i)}, 1, 2), '/', substr({compact(long_, i)}, 3, 2), '/', substr({compact(long_, i)}, 5, 4))"
    dotted = lambda i: f"concat(substr({compact(short, i)}, 5, 2), '.', substr({compact(short, i)}, 3, 2), '.', CASE WHEN CAST(substr({compact(short, i)}, 1, 2) AS INT) >= 30 THEN '19' ELSE '20' END, substr({compact(short, i)}, 1, 2))"
    either = lambda a, b: f"CASE WHEN regexp_matches(squashed, '{long_}') THEN {a} WHEN regexp_matches(squashed, '{short}') THEN {b} END"
    with_state, alone = "P<([A-Z]{3})([A-Z<]+?)<<([A-Z<]+)", "P<([A-Z<]+?)<<([A-Z<]+)"
    line1 = lambda i: f"CASE WHEN regexp_matches(clean, '{with_state}') THEN {name(f'''regexp_extract(clean, '{with_state}', {i + 1})''')} WHEN regexp_matches(clean, '{alone}') THEN {name(f'''regexp_extract(clean, '{alone}', {i})''')} END"
    sexed = "coalesce(nullif(sex, ''), office)"
    authority = "nullif(trim(regexp_replace(regexp_replace(regexp_replace(office, '^.*?AUTHORITY[^A-Z0-9a-z]*', '', 'i'), '^.*?AUTORIDAD[^A-Z0-9a-z]*', '', 'i'), '^.*?AUTORIT.{0,4}[^A-Z0-9a-z]*', '', 'i'), ' :-/'), '')"
    current = "coalesce(s1, z_surname, CASE WHEN length(guess) <= 4 THEN guess2 END, guess)"
    rules = [
        ("document_number", "zone", "CASE WHEN regexp_full_match(z_document_number, '[A-Z0-9]{7,10}') THEN z_document_number END"), ("document_number", "compact", "CASE WHEN regexp_full_match(c_number, '[A-Z0-9]{7,10}') THEN c_number END"), ("document_number", "text", "often"),
        ("surname", "names", f"CASE WHEN coalesce(length(regexp_replace(upper({current}), '[^A-Z]', '', 'g')), 0) <= 2 THEN crop_surname END"), ("surname", "line1", "s1"), ("surname", "zone", "z_surname"), ("surname", "names_before", "CASE WHEN length(guess) <= 4 THEN guess2 END"), ("surname", "text", "guess"),
        ("given_names", "line1", "g1"), ("given_names", "zone", "z_given_names"), ("given_names", "text", _after("ls", "GIVEN NAMES")), ("given_names", "names_label", _after("nls", "GIVEN NAMES")), ("given_names", "names", "crop_given"),
        ("nationality", "zone", "CASE WHEN regexp_full_match(z_nationality, '[A-Z]{3}') THEN z_nationality END"), ("nationality", "compact", "c_nationality"), ("nationality", "text", _after("ls", "NATIONALITY")), ("nationality", "phrase", "CASE WHEN contains(upper(said), 'UNITED ARAB EMIRATES') THEN 'ARE' WHEN contains(upper(said), 'UNITED STATES OF AMERICA') THEN 'USA' END"),
        ("date_of_birth", "zone", "z_date_of_birth"), ("date_of_birth", "compact", "c_birth"), ("date_of_birth", "text", _after("ls", "DATE OF BIRTH")), ("date_of_birth", "place", "found[1]"),
        ("date_of_issue", "text", _after("ls", "DATE OF ISUS", "DATE OF ISSUE", "DATE OF DE")), ("date_of_issue", "authority", r"nullif(regexp_extract(office, '\b[0-9]{2}/[0-9]{2}/[0-9]{4}\b'), '')"), ("date_of_issue", "place", "found[2]"),
        ("date_of_expiry", "zone", "z_date_of_expiry"), ("date_of_expiry", "compact", "c_expiry"), ("date_of_expiry", "text", _after("ls", "DATE OF EXPIRATION", "DATE OF EXPIRY")), ("date_of_expiry", "place", "coalesce(found[3], found[2])"),
        ("sex", "zone", "CASE WHEN z_sex IN ('M', 'F', 'X') THEN z_sex END"), ("sex", "compact", "c_sex"), ("sex", "text", rf"coalesce(nullif(regexp_extract(upper({sexed}), 'SEX[^A-Z0-9]*([MFX])(?:[^A-Z]|$)', 1), ''), nullif(regexp_extract(upper({sexed}), '\b([MFX])\b', 1), ''))"),
        ("place_of_birth", "text", f"replace({_after('ls', 'LIEU DE NAISSANCE', 'LUGAR DE NACIMIENTO', 'PLANO / PLANO')}, 'ILINIOIS', 'ILLINOIS')"),
        ("issuing_authority", "authority", f"CASE WHEN office IS NULL THEN NULL WHEN contains({authority}, 'Department of State') THEN 'United States Department of State' ELSE coalesce({authority}, '-') END"), ("issuing_authority", "text", _line("ls", "DEPARTMENT OF STATE", "AUTHORITY", "AUTORITE")),
        ("mrz", "zone", "best"),
    ]
    cells = ", ".join("{" + f"'field': '{f}', 'rank': {i}, 'source': '{s}', 'value': CAST({v} AS VARCHAR)" + "}" for i, (f, s, v) in enumerate(rules))
    pivot = ", ".join(f"max(value) FILTER (WHERE field = '{f}') AS {f}, max(source) FILTER (WHERE field = '{f}' AND value IS NOT NULL) AS {f}_source" for f in identity.PASSPORT_FIELDS)
    surname = "CASE WHEN {u} THEN v END"
    return rf"""WITH src AS ({PASSPORTS}),
a AS (SELECT *, {_lines('said')} AS ls, {_lines("coalesce(names, '')")} AS nls, nullif(trim(zone), '') AS z, nullif(trim(regexp_replace(array_to_string({_lines("coalesce(authority, '')")}, ' '), '\s+', ' ', 'g'), ' :'), '') AS office FROM src),
b AS (SELECT *, coalesce(nullif(array_to_string([x for x in ls if contains(x, '<') AND length(x) >= 20], ' '), ''), z) AS merged, regexp_replace(upper(said), '[^A-Z0-9]', '', 'g') AS squashed, regexp_extract_all(said, '{_NAMED_DATE}') AS found, {_before('ls')} AS guess, {_before('nls')} AS guess2 FROM a),
texts AS (SELECT id, 1 AS k, z AS t FROM b UNION ALL SELECT id, 2, merged FROM b), {_zone_parts('texts')},
zc AS (SELECT *, {' + '.join(f'CAST({f} IS NOT NULL AS INT)' for f in _ZONED)} AS n FROM zp),
c AS (SELECT b.*, CASE WHEN coalesce(p.n, 0) >= coalesce(q.n, 0) THEN 1 ELSE 2 END AS k FROM b LEFT JOIN zc p ON p.id = b.id AND p.k = 1 LEFT JOIN zc q ON q.id = b.id AND q.k = 2),
d AS (SELECT c.*, {', '.join(f'zc.{f} AS z_{f}' for f in _ZONED)}, CASE WHEN c.k = 1 THEN z ELSE merged END AS best, regexp_replace(upper(CASE WHEN c.k = 1 THEN z ELSE merged END), '[^A-Z<]', '', 'g') AS clean FROM c LEFT JOIN zc ON zc.id = c.id AND zc.k = c.k),
w AS (SELECT id, i, [x for x in string_split(trim(regexp_replace(replace(nls[i], '/', ' '), '\s+', ' ', 'g')), ' ') if regexp_full_match(x, '[A-Za-z-]+')] AS ws FROM d, unnest(range(1, len(nls) + 1)) r(i)),
n AS (SELECT id, arg_min(ws, i) AS ws FROM w WHERE len(ws) >= 2 AND len([x for x in ws if upper(x) IN ('UNITED', 'COUNTRY', 'CODE', 'PASSPORT', 'NAME', 'NAMES', 'NATIONALITY', 'TYPE', 'PLACE', 'BIRTH')]) = 0 AND len([x for x in ws if regexp_matches(x, '[a-z]')]) > 0 GROUP BY id),
o AS (SELECT id, arg_min(v, (-n, v)) AS often FROM (SELECT id, v, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(said, '\b[0-9]{{8,9}}\b')) AS v FROM d) GROUP BY id, v) GROUP BY id),
e AS (SELECT d.*, o.often, trim(replace(upper(ws[-1]), '-', ' ')) AS crop_surname, nullif(trim(replace(upper(array_to_string(ws[:-2], ' ')), '-', ' ')), '') AS crop_given, {line1(1)} AS s1, {line1(2)} AS g1,
{either(compact(long_, 1), compact(short, 1))} AS c_number, {either(compact(long_, 2), compact(short, 2))} AS c_nationality, {either(slashed(3), dotted(3))} AS c_birth, {either(compact(long_, 4), compact(short, 4))} AS c_sex, {either(slashed(5), dotted(5))} AS c_expiry FROM d LEFT JOIN n ON n.id = d.id LEFT JOIN o ON o.id = d.id),
cells AS (SELECT id, unnest([{cells}]) AS x FROM e),
best AS (SELECT id, x.field AS field, x.source AS source, nullif(x.value, '-') AS value FROM cells WHERE coalesce(trim(x.value), '') <> '' QUALIFY row_number() OVER (PARTITION BY id, x.field ORDER BY x.rank) = 1),
named AS (SELECT id, field, source, CASE field WHEN 'surname' THEN (SELECT {_SURNAME} FROM (SELECT CASE WHEN starts_with(t, 'USA') AND length(t) > 3 THEN substr(t, 4) ELSE nullif(t, '') END AS x FROM (SELECT trim(regexp_replace(upper(value), '[^A-Z ]', '', 'g')) AS t)))
  WHEN 'given_names' THEN nullif(trim(regexp_replace(regexp_replace(regexp_replace(upper(value), '[^A-Z ]', ' ', 'g'), '\b(?:USAF|USA|ISSUE|DATE|BIRTH|PLACE|NATIONALITY|PASSPORT)\b', ' ', 'g'), '\s+', ' ', 'g')), '') ELSE value END AS v FROM best),
kept AS (SELECT id, field, source, CASE WHEN field NOT IN ('surname', 'given_names') OR {_USEFUL.format(v='v')} THEN v END AS value FROM named),
r AS (SELECT id, {pivot} FROM kept GROUP BY id), m AS (SELECT *, {' + '.join(f"CAST(coalesce(trim({f}), '') <> '' AS INT)" for f in identity.PASSPORT_FIELDS)} AS populated FROM (SELECT src.id AS id, r.* EXCLUDE (id) FROM src LEFT JOIN r ON r.id = src.id))
SELECT *, populated >= 4 AS is_valid, CASE WHEN populated >= 4 THEN 'heuristic_passport_mapping' ELSE 'passport_mapping_low_confidence' END AS code, CASE WHEN populated >= 4 THEN 'info' ELSE 'warning' END AS severity FROM m"""


def _flat(df, fields):
    columns = [F.col(f"record.fields.{f}").alias(f) for f in fields] + [F.col(f"record.sources.{f}").alias(f"{f}_source") for f in fields]
    return df.select("id", *columns, "record.populated", "record.is_valid", "record.code", "record.severity")


@query(_passport_sql())
def passport_records(spark, sf_dir):
    found = identity.passports(derive(spark, sf_dir, PASSPORTS), "said", "zone", "names", "sex", "authority")
    return _flat(found, identity.PASSPORT_FIELDS)


#: Pages of identity cards.
CARDS = """
SELECT c_custkey AS id, concat_ws(chr(10), CASE c_custkey % 4 WHEN 0 THEN 'Surname / Nom' WHEN 1 THEN 'Family name' END, CASE WHEN c_custkey % 3 <> 1 THEN c_mktsegment END, CASE WHEN c_custkey % 5 < 3 THEN 'Given names' WHEN c_custkey % 5 = 3 THEN 'Prenoms' END, CASE WHEN c_custkey % 7 <> 3 THEN concat('Anna ', CAST(c_nationkey AS STRING)) END,
  CASE WHEN c_custkey % 6 < 2 THEN 'Citizenship' END, CASE WHEN c_custkey % 11 = 1 THEN 'X' END, CASE c_custkey % 9 WHEN 0 THEN 'born 12.03.1974' WHEN 1 THEN '01-02-80 and 05/06/2019 and 07 Aug 2029' WHEN 2 THEN '03/04/1990 04/05/2020' WHEN 3 THEN 'Date of birth' WHEN 4 THEN 'Naissance 01/02/03' END, CASE WHEN c_custkey % 2 = 0 THEN concat(lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0'), '.05.2001') END,
  CASE c_custkey % 8 WHEN 0 THEN 'Issue date' WHEN 1 THEN 'Valid until' WHEN 2 THEN 'Delivered' WHEN 3 THEN 'Expiry date' END, CASE WHEN c_custkey % 10 < 7 THEN concat('ID', lpad(CAST(c_custkey AS STRING), 6, '0'), ' AB12345 ', CASE WHEN c_custkey % 20 < 9 THEN 'AB12345' ELSE '' END) END, CASE c_custkey % 12 WHEN 0 THEN 'Sex' WHEN 1 THEN 'Gender' WHEN 2 THEN 'Address / Adresse' WHEN 3 THEN 'Personal number' WHEN 4 THEN 'PIN' END,
  CASE WHEN c_custkey % 13 < 9 THEN concat('F ', CAST(c_nationkey AS STRING)) END, CASE c_custkey % 14 WHEN 0 THEN 'issued by the city' WHEN 1 THEN 'Departement' WHEN 2 THEN 'Authority 9' END) AS said FROM customer"""


def _core_cells() -> list[tuple[str, str, str]]:
    given = _after("ls", *identity.CORE_LABELS["given_names"])
    at = lambda f: _after("ls", *identity.CORE_LABELS[f])
    return [("document_number", "token", "often"), ("surname", "label", at("surname")), ("surname", "before", f"CASE WHEN {given} IS NOT NULL THEN {_before('ls')} END"), ("given_names", "label", given), ("nationality", "label", at("nationality")), ("date_of_birth", "label", at("date_of_birth")), ("date_of_birth", "place", "found[1]"), ("date_of_issue", "label", at("date_of_issue")), ("date_of_issue", "place", "found[2]"), ("date_of_expiry", "label", at("date_of_expiry")), ("date_of_expiry", "place", "coalesce(found[3], found[2])"), ("issuing_authority", "line", _line("ls", *identity.CORE_LABELS["issuing_authority"]))]


def _cells(rules: list[tuple[str, str, str]]) -> str:
    return ", ".join("{" + f"'field': '{f}', 'rank': {i}, 'source': '{s}', 'value': CAST({v} AS VARCHAR)" + "}" for i, (f, s, v) in enumerate(rules))


def _core_sql(source: str, lines: str, rules: list[tuple[str, str, str]]) -> str:
    """CTEs up to best (id, field, source, value): ranked candidates of a source, whose lines are given."""
    return rf"""src AS ({source}), l AS (SELECT id, {lines} AS ls FROM src), t AS (SELECT *, array_to_string(ls, ' ') AS whole FROM l),
o AS (SELECT id, arg_min(v, (-n, v)) AS often FROM (SELECT id, v, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(whole, '\b[A-Z0-9]{{6,12}}\b')) AS v FROM t) GROUP BY id, v) GROUP BY id),
e AS (SELECT t.*, o.often, regexp_extract_all(whole, '{_ANY_DATE}') AS found FROM t LEFT JOIN o ON o.id = t.id), cells AS (SELECT id, unnest([{_cells(rules)}]) AS x FROM e),
best AS (SELECT id, x.field AS field, x.source AS source, x.value AS value FROM cells WHERE coalesce(trim(x.value), '') <> '' QUALIFY row_number() OVER (PARTITION BY id, x.field ORDER BY x.rank) = 1)"""


def _card_sql() -> str:
    rules = _core_cells() + [(f, "label", _after("ls", *identity.CARD_LABELS[f])) for f in ("address", "personal_number", "sex")]
    pivot = ", ".join(f"max(value) FILTER (WHERE field = '{f}') AS {f}, max(source) FILTER (WHERE field = '{f}') AS {f}_source" for f in identity.CARD_FIELDS)
    return f"""WITH {_core_sql(CARDS, _lines('said'), rules)}, r AS (SELECT id, {pivot}, count(*) AS populated FROM best GROUP BY id), m AS (SELECT src.id AS id, r.* EXCLUDE (id, populated), CAST(coalesce(populated, 0) AS INT) AS populated FROM src LEFT JOIN r ON r.id = src.id)
SELECT *, populated >= 4 AS is_valid, CASE WHEN populated >= 4 THEN 'heuristic_id_card_mapping' ELSE 'identity_mapping_low_confidence' END AS code, CASE WHEN populated >= 4 THEN 'info' ELSE 'warning' END AS severity FROM m"""


@query(_card_sql())
def id_card_records(spark, sf_dir):
    return _flat(identity.id_cards(derive(spark, sf_dir, CARDS), "said"), identity.CARD_FIELDS)


#: Pages of driver licences from three readings: the number field, the dates and the whole page.
LICENCES = """
SELECT c_custkey AS id,
  CASE c_custkey % 7 WHEN 0 THEN concat('DL ', 'I', lpad(CAST(c_custkey AS STRING), 7, '0')) WHEN 1 THEN concat('DL', chr(10), lpad(CAST(c_custkey AS STRING), 7, '0')) WHEN 2 THEN concat('CLASS C', chr(10), lpad(CAST(c_custkey * 17 AS STRING), 6, '0')) WHEN 3 THEN 'CALIFORNIA DRIVER LICENSE' WHEN 4 THEN concat('lic ', 'ab', CAST(c_custkey AS STRING)) WHEN 5 THEN concat('no. X', lpad(CAST(c_custkey AS STRING), 6, '0')) END AS number_text,
  concat_ws(chr(10), CASE c_custkey % 5 WHEN 0 THEN 'DOB 08311977' WHEN 1 THEN 'DOB: 08/31/77' WHEN 2 THEN concat('DOB', chr(10), '08/31/1977') WHEN 3 THEN '08/31/1977' END,
    CASE c_custkey % 6 WHEN 0 THEN 'ISS 08312009' WHEN 1 THEN 'DD 08/31/2009 99' WHEN 2 THEN 'ISS 08/31/1977' WHEN 3 THEN 'ISS 08/31/2019' WHEN 4 THEN 'Issued 01/02/203' END,
    CASE c_custkey % 4 WHEN 0 THEN 'EXP 08/31/2014' WHEN 1 THEN 'exp: 08/31/14' WHEN 2 THEN 'EXPIRY 08/31/12014' END, CASE WHEN c_custkey % 11 = 3 THEN '08/31/1777' WHEN c_custkey % 11 = 5 THEN '02032004 08312014' WHEN c_custkey % 11 = 7 THEN '12345678 03/04/2005 05/06/2007' END) AS dates_text,
  concat_ws(chr(10), 'California  USA', CASE WHEN c_custkey % 3 = 0 THEN concat('LN ', c_mktsegment) WHEN c_custkey % 3 = 1 THEN concat('Last name', chr(10), c_mktsegment, '-9 x') END, CASE WHEN c_custkey % 8 < 3 THEN concat('FN: ', c_name) WHEN c_custkey % 8 = 3 THEN 'FN' WHEN c_custkey % 8 = 4 THEN 'Given names' END,
    CASE WHEN c_custkey % 9 < 4 THEN concat(CAST(c_nationkey AS STRING), ' MAIN ST') WHEN c_custkey % 9 = 4 THEN 'DOB 5' END, CASE WHEN c_custkey % 10 < 3 THEN concat('ANYTOWN CA ', lpad(CAST(c_custkey % 100000 AS STRING), 5, '0')) END, CASE WHEN c_custkey % 12 = 2 THEN concat('Address', chr(10), 'Road ', CAST(c_nationkey AS STRING)) END,
    CASE c_custkey % 13 WHEN 0 THEN 'CLASS C' WHEN 1 THEN 'Categories B, BE; C1' WHEN 2 THEN 'CAT. A  class B' WHEN 3 THEN 'class: none T' END, CASE WHEN c_custkey % 14 = 1 THEN concat('Place of birth', chr(10), 'Town') END, CASE WHEN c_custkey % 15 < 4 THEN 'issued by DMV' END, 'california usa',
    CASE c_custkey % 16 WHEN 0 THEN lpad(CAST(c_custkey AS STRING), 9, '1') WHEN 1 THEN concat('EXP', chr(10), '7654321') WHEN 2 THEN 'ref K1234567 of 2' WHEN 3 THEN '02032004' END) AS said FROM customer"""


def _mmdd(t: str) -> str:
    d = f"regexp_replace({t}, '[^0-9]', '', 'g')"
    return f"coalesce(length({d}) = 8 AND TRY_CAST(substr({d}, 1, 2) AS INT) BETWEEN 1 AND 12 AND TRY_CAST(substr({d}, 3, 2) AS INT) BETWEEN 1 AND 31 AND TRY_CAST(substr({d}, 5, 4) AS INT) BETWEEN 1900 AND 2099, false)"


def _first(items: str) -> str:
    return f"[y for y in {items} if y IS NOT NULL][1]"


def _slashed(t: str) -> str:
    return f"concat(substr({t}, 1, 2), '/', substr({t}, 3, 2), '/', substr({t}, 5, 4))"


def _identity_date(v: str) -> str:
    """A date of a licence from a value; t8 has the tokens of eight digits of all lines."""
    x = lambda p, i=0: rf"regexp_extract({v}, '\b{p}\b', {i})"
    has = lambda p: rf"regexp_matches({v}, '\b{p}\b')"
    direct, long_, over = "([0-9]{2})/([0-9]{2})/([0-9]{4})", "([0-9]{2})/([0-9]{2})/1([0-9]{4})", "([0-9]{2})/([0-9]{2})/([0-9]{2})([0-9]{4})"
    three, two, eight = "([0-9]{2})/([0-9]{2})/([0-9]{3})", "([0-9]{2})/([0-9]{2})/([0-9]{2})", "([0-9]{8})"
    token = lambda p, more="": _slashed(f"[y for y in t8 if starts_with(y, concat({x(p, 1)}, {x(p, 2)})){more}][1]")
    some = lambda t: f"nullif({t}, '//')"
    year = f"TRY_CAST({x(direct, 3)} AS INT)"
    dated = lambda p, y: f"concat({x(p, 1)}, '/', {x(p, 2)}, '/', {y})"
    in_range = " AND TRY_CAST(substr(y, 5, 4) AS INT) BETWEEN 1900 AND 2099"
    return f"""CASE WHEN {has(direct)} THEN CASE WHEN {year} BETWEEN 1900 AND 2099 THEN {x(direct)} ELSE coalesce({some(token(direct, in_range))}, CASE WHEN {year} BETWEEN 1600 AND 1899 THEN {dated(direct, f"concat('19', right({x(direct, 3)}, 2))")} WHEN {year} BETWEEN 2100 AND 2999 THEN {dated(direct, f"concat('20', right({x(direct, 3)}, 2))")} END, {x(direct)}) END
WHEN {has(long_)} THEN {dated(long_, x(long_, 3))} WHEN {has(over)} THEN {dated(over, x(over, 4))} WHEN {has(three)} THEN coalesce({some(token(three))}, {dated(three, f"concat('1', {x(three, 3)})")})
WHEN {has(two)} THEN coalesce({some(token(two))}, {dated(two, f"concat(CASE WHEN TRY_CAST({x(two, 3)} AS INT) >= 30 THEN '19' ELSE '20' END, {x(two, 3)})")})
WHEN {has(eight)} AND {_mmdd(x(eight, 1))} THEN {_slashed(x(eight, 1))} WHEN regexp_matches({v}, '[0-9]') THEN trim({v}) END"""


def _labelled_date(label: str, known: str) -> str:
    """The first date behind a label that isn't known, line by line."""
    raw = rf"nullif(regexp_extract(upper(z), '\b{label}\b[^0-9]*([0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{8}})', 1), '')"
    return f"[q for q in [{_identity_date('d')} for d in [{raw} for z in ls]] if q IS NOT NULL AND NOT list_contains({known}, q)][1]"


def _issue(birth: str, expiry: str) -> str:
    known = f"[coalesce({birth}, ''), coalesce({expiry}, '')]"
    bare = r"flatten([list_reverse(regexp_extract_all(z, '\b[0-9]{2}/[0-9]{2}/[0-9]{4}\b')) for z in ls])"
    return f"coalesce({_labelled_date('ISS', known)}, {_labelled_date('DD', known)}, [q for q in {bare} if NOT list_contains({known}, q)][1])"


def _birth(issue: str, expiry: str) -> str:
    known = f"[coalesce({issue}, ''), coalesce({expiry}, '')]"
    return f"coalesce({_labelled_date('DOB', known)}, [q for q in [{_slashed('y')} for y in t8 if {_mmdd('y')}] if NOT list_contains({known}, q)][1])"


_NO_NUMBER = "('CALIFORNIA', 'ALIFORNIA', 'DRIVER', 'LICENSE', 'CLASS', 'NONE')"


def _good_token(t: str, ex: str) -> str:
    return f"upper({t}) NOT IN {_NO_NUMBER} AND NOT list_contains({ex}, {t}) AND NOT {_mmdd(t)}"


def _digit_line(t: str, ex: str) -> str:
    return f"regexp_full_match({t}, '[0-9]{{6,12}}') AND NOT list_contains({ex}, {t})"


_NEAR = "(regexp_matches(upper(coalesce(ls[i - 1], '')), 'DL|EXP|CLASS') AND i > 1 OR regexp_matches(upper(coalesce(ls[i + 1], '')), 'DL|EXP|CLASS'))"
_TOKEN = r"regexp_extract_all({}, '\b[A-Z0-9]{{6,12}}\b')"


def _beside_label(ex: str) -> str:
    return f"ls[list_min([i for i in range(1, len(ls) + 1) if {_digit_line('ls[i]', ex)} AND NOT {_mmdd('ls[i]')} AND {_NEAR}])]"


def _fallback_number(ex: str) -> str:
    bare = f"list_sort([{{'dated': {_mmdd('y')}, 'n': -length(y), 'v': y}} for y in ls if {_digit_line('y', ex)}])[1].v"
    return f"coalesce({_beside_label(ex)}, {bare}, [t for t in flatten([{_TOKEN.format('y')} for y in ls]) if {_good_token('t', ex)}][1])"


_STARTS = "[i for i in range(1, len(ls) + 1) if contains(upper(ls[i]), 'FN ') OR starts_with(upper(ls[i]), 'FN')]"
_ADDRESS = f"[y for y in flatten([ls[i + 1:i + 4] for i in {_STARTS}]) if regexp_matches(y, '[0-9]') AND NOT regexp_matches(upper(y), 'DOB|EXP|SEX|HAIR|EYES|WGT|RGT|ISS|DD')][1]"
_LICENCE_KINDS = "AM|A1|A2|A|B1|B|C1|C|D1|D|BE|CE|DE|T"
_EXPLICIT = rf"[y for y in [regexp_extract(u, '\bCLASS\s+({_LICENCE_KINDS})\b', 1), regexp_extract(u, '\b(?:CATEGORY|CATEGORIES|CAT\.)\s+({_LICENCE_KINDS})\b', 1)] if y <> '']"
_TAIL = "CASE WHEN contains(u, 'CATEGORY') THEN substr(u, instr(u, 'CATEGORY') + 8) WHEN contains(u, 'CATEGORIES') THEN substr(u, instr(u, 'CATEGORIES') + 10) WHEN contains(u, 'CAT.') THEN substr(u, instr(u, 'CAT.') + 4) ELSE substr(u, instr(u, 'CLASS') + 5) END"
_OF_LINE = rf"CASE WHEN len({_EXPLICIT}) > 0 THEN {_EXPLICIT} ELSE regexp_extract_all({_TAIL}, '\b(?:{_LICENCE_KINDS})\b') END"
_ALL_KINDS = rf"flatten([{_OF_LINE} for u in [upper(y) for y in ls] if regexp_matches(u, 'CATEGORY|CATEGORIES|CAT\.|CLASS')])"
_KINDS_ONCE = f"(SELECT list(k ORDER BY i) FROM (SELECT k, min(i) AS i FROM (SELECT unnest({_ALL_KINDS}) AS k, generate_subscripts({_ALL_KINDS}, 1) AS i) GROUP BY k))"


def _united_lines(*columns: str) -> str:
    """Lines of several columns, each once in its first spelling."""
    raw = "[regexp_replace(y, ' +', ' ', 'g') for y in flatten([" + ", ".join(_lines(f"coalesce({c}, '')") for c in columns) + "])]"
    return f"(SELECT [x.l[i] for i in range(1, len(x.l) + 1) if list_position(x.u, x.u[i]) = i] FROM (SELECT {{'l': {raw}, 'u': [upper(y) for y in {raw}]}} AS x))"


def _licence_sql() -> str:
    labels = identity.LICENCE_LABELS
    rules = [(f, "beside", _beside("ls", *labels[f])) for f in ("surname", "given_names", "date_of_birth", "date_of_issue", "date_of_expiry")] + _core_cells()
    rules += [("address", "label", _after("ls", *labels["address"])), ("address", "after_name", _ADDRESS), ("place_of_birth", "label", _after("ls", *labels["place_of_birth"]))]
    pivot = ", ".join(f"max(value) FILTER (WHERE field = '{f}') AS {f}" for f in dict.fromkeys(f for f, *_ in rules))
    labelled = f"[coalesce([t for t in {_TOKEN.format('ls[i]')} if {_good_token('t', 'ex')}][1], [t for t in ls[i + 1:i + 2] if {_digit_line('t', 'ex')} AND NOT {_mmdd('t')}][1]) for i in range(1, len(ls) + 1) if regexp_matches(upper(ls[i]), 'LIC|DL|DI')]"
    again = _beside_label("ex2")
    behind = rf"[t for t in [regexp_extract(upper(y), '\bDL\b[^0-9A-Z]*([A-Z0-9]{{6,12}})', 1) for y in ls] if t <> '' AND t NOT IN ('CALIFORNIA', 'ALIFORNIA') AND NOT list_contains(ex2, t) AND NOT {_mmdd('t')}][1]"
    compact = "regexp_replace(upper(chosen), '[^A-Z0-9]', '', 'g')"
    digits = lambda *cs: "[y for y in [" + ", ".join(f"regexp_replace({c}, '[^0-9]', '', 'g')" for c in cs) + "] if y <> '']"
    order = lambda c: f"CASE WHEN regexp_full_match({c}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') AND TRY_CAST(substr({c}, 1, 2) AS INT) BETWEEN 1 AND 12 AND TRY_CAST(substr({c}, 4, 2) AS INT) BETWEEN 1 AND 31 AND TRY_CAST(substr({c}, 7, 4) AS INT) BETWEEN 1900 AND 2099 THEN concat(substr({c}, 7, 4), substr({c}, 1, 2), substr({c}, 4, 2)) END"
    name = lambda c: f"nullif(trim(regexp_replace(regexp_replace(upper({c}), '[^A-Z -]', ' ', 'g'), ' +', ' ', 'g'), ' -'), '')"
    useful = lambda c: f"CASE WHEN {_USEFUL.format(v=name(c))} THEN {name(c)} END"
    united = _united_lines("number_text", "dates_text", "said")
    fields = ["license_number", "surname", "given_names", "birth AS date_of_birth", "place_of_birth", "address", "issue AS date_of_issue", "expiry AS date_of_expiry", "issuing_authority"]
    plain = [f.split(" ")[0] for f in fields]
    return rf"""WITH {_core_sql(LICENCES, united, rules)}, p AS (SELECT id, {pivot} FROM best GROUP BY id),
a AS (SELECT t.id AS id, ls, flatten([regexp_extract_all(y, '\b[0-9]{{8}}\b') for y in ls]) AS t8, p.* EXCLUDE (id), {digits('date_of_birth', 'date_of_expiry')} AS ex FROM t LEFT JOIN p ON p.id = t.id),
b AS (SELECT *, coalesce({_first(labelled)}, {_fallback_number('ex')}) AS number, CASE WHEN date_of_issue IS NULL OR starts_with(upper(date_of_issue), 'DD ') THEN coalesce({_issue('date_of_birth', 'date_of_expiry')}, date_of_issue) ELSE date_of_issue END AS i0 FROM a),
c AS (SELECT *, {_identity_date('date_of_birth')} AS b1, {_identity_date('i0')} AS i1, {_identity_date('date_of_expiry')} AS expiry FROM b),
d AS (SELECT *, CASE WHEN b1 IS NULL OR b1 = i1 THEN coalesce({_birth('i1', 'expiry')}, b1) ELSE b1 END AS birth FROM c),
f AS (SELECT *, CASE WHEN i1 IS NOT DISTINCT FROM birth THEN {_issue('birth', 'expiry')} ELSE i1 END AS i2 FROM d),
g AS (SELECT *, CASE WHEN coalesce({order('i2')} > {order('expiry')}, false) THEN NULL ELSE i2 END AS issue, coalesce(number, document_number) AS chosen, {digits('birth', 'expiry')} AS ex2 FROM f),
h AS (SELECT * REPLACE ({useful('surname')} AS surname, {useful('given_names')} AS given_names), CASE WHEN chosen IS NULL THEN NULL WHEN {compact} NOT IN ('CALIFORNIA', 'ALIFORNIA', 'DRIVERLICENSE') AND regexp_matches({compact}, '[0-9]') AND NOT (regexp_full_match({compact}, '[0-9]+') AND (list_contains(ex2, {compact}) OR {_mmdd(compact)})) THEN {compact} ELSE coalesce({again}, {behind}) END AS license_number,
  {_KINDS_ONCE} AS kinds FROM g),
m AS (SELECT id, {', '.join(fields)}, coalesce(array_to_string(kinds, ','), '') AS categories, CAST({' + '.join(f"CAST(coalesce(trim({x}), '') <> '' AS INT)" for x in plain)} + coalesce(len(kinds), 0) AS INT) AS populated FROM h)
SELECT *, populated >= 4 AS is_valid, CASE WHEN populated >= 4 THEN 'heuristic_driver_license_mapping' ELSE 'identity_mapping_low_confidence' END AS code, CASE WHEN populated >= 4 THEN 'info' ELSE 'warning' END AS severity FROM m"""


@query(_licence_sql())
def licence_records(spark, sf_dir):
    found = identity.driver_licences(derive(spark, sf_dir, LICENCES), ["number_text", "dates_text", "said"])
    return found.select("id", *(F.col(f"record.fields.{f}").alias(f) for f in identity.LICENCE_FIELDS), F.array_join("record.fields.categories", ",").alias("categories"), "record.populated", "record.is_valid", "record.code", "record.severity")


#: Zones of persons, damaged in fourteen ways: both lines, cut, joined, with lost or doubled characters, in lower case, within other text.
ANSWERS = f"""
SELECT id, CASE id % 14 WHEN 0 THEN concat(l1, chr(10), l2) WHEN 1 THEN concat(lower(l1), chr(10), ' ', l2, ' ') WHEN 2 THEN concat(substr(l1, 2), chr(10), l2) WHEN 3 THEN concat('<', substr(l1, 1, 40), chr(10), l2) WHEN 4 THEN concat('<<', substr(l1, 3, 30)) WHEN 5 THEN concat('PPD<<', surname, '<<', given, '<AL', chr(10), replace(l2, country, 'D<<'))
  WHEN 6 THEN concat('P<', surname, '<<', given, '<EL', chr(10), '--', chr(10), l2) WHEN 7 THEN concat('PP<', substr(l1, 3, 20), chr(10), replace(l2, '0', 'O')) WHEN 8 THEN substr(l1, 1, 30) WHEN 9 THEN l2 WHEN 10 THEN concat('班级：___ the zone: ', l1, l2, ' </end>') WHEN 11 THEN concat(chr(10), '  ', chr(10)) WHEN 12 THEN concat('P<', country, surname, '><', given, '<Z4<', chr(10), substr(l2, 1, 28)) ELSE concat('P<', surname, 'SON<<', given, '<AL<<', number) END AS t
FROM (SELECT *, rpad(concat('P<', country, surname, '<<', given), 44, '<') AS l1, concat(number, '7', country, birth, '3', sex, expiry, '1', '<<<<<<<<<<<<<<', '08') AS l2 FROM ({PERSONS}))"""
STATES = {"RUS": "RUSSIAN FEDERATION", "USA": "UNITED STATES OF AMERICA", "DEU": "GERMANY", "D": "GERMANY", "FRA": "FRANCE", "GBR": "GREAT BRITAIN"}
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in STATES.items()) + "}"
_SECOND = "([A-Z0-9<]{9})[0-9<]([A-Z<]{3})([0-9]{6})[0-9<]([MF<])([0-9]{6})"


def _second_sql(found: str, state: str) -> str:
    x = lambda i: f"regexp_extract({found}, '{_SECOND}', {i})"
    date = lambda i: f"CASE WHEN {x(i)} <> '' THEN concat(substr({x(i)}, 5, 2), '.', substr({x(i)}, 3, 2), '.', CASE WHEN CAST(substr({x(i)}, 1, 2) AS INT) >= 50 THEN '19' ELSE '20' END, substr({x(i)}, 1, 2)) END"
    plain = lambda i: f"replace({x(i)}, '<', '')"
    return f"coalesce({state}, {_MAP}[{plain(2)}], {_MAP}[{x(2)}]) AS nationality, CASE WHEN regexp_matches({plain(1)}, '[0-9]') THEN {plain(1)} END AS document_number, {date(3)} AS date_of_birth, CASE WHEN {plain(4)} IN ('M', 'F') THEN {plain(4)} END AS sex, {date(5)} AS date_of_expiry"


def _token(c: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_replace(upper({c}), '[^A-Z'' -]+', ' ', 'g'), ' +', ' ', 'g')), '')"


def _is_state(x: str) -> str:
    return f"coalesce(list_contains(map_keys({_MAP}), substr({x}, 1, 3)) AND length({x}) >= 3, false)"


@query(rf"""WITH src AS ({ANSWERS}), a AS (SELECT id, [regexp_replace(upper(x), '[^A-Z0-9<]', '', 'g') for x in string_split(t, chr(10)) if trim(x) <> ''] AS ls FROM src WHERE t <> ''),
b AS (SELECT *, CASE WHEN starts_with(ls[1], 'PPD<<') THEN substr(ls[1], 6) WHEN starts_with(ls[1], 'P<') THEN substr(ls[1], 3) WHEN starts_with(ls[1], 'PP<') THEN substr(ls[1], 4) WHEN starts_with(ls[1], 'P') THEN substr(ls[1], 2) ELSE ls[1] END AS y FROM a WHERE len(ls) > 0),
c AS (SELECT *, CASE WHEN starts_with(y, '<<') THEN CASE WHEN {_is_state('substr(y, 3)')} THEN substr(y, 3) ELSE y END WHEN starts_with(y, '<') AND {_is_state('substr(y, 2)')} THEN substr(y, 2) ELSE y END AS x FROM b),
d AS (SELECT *, CASE WHEN {_is_state('x')} THEN substr(x, 1, 3) END AS code FROM c), e AS (SELECT *, CASE WHEN code IS NULL THEN x ELSE substr(x, 4) END AS payload, coalesce(nullif(ls[2], ''), ls[1]) AS second FROM d),
f AS (SELECT *, instr(payload, '<<') AS p FROM e), g AS (SELECT *, CASE WHEN p > 0 THEN {_token('substr(payload, 1, p - 1)')} END AS s, CASE WHEN p > 0 THEN {_token('substr(payload, p + 2)')} END AS given_names FROM f),
h AS (SELECT id, array_to_string(ls, chr(10)) AS mrz, CASE WHEN code IS NULL AND string_split(given_names, ' ')[-1] IN ('AL', 'EL') THEN trim(concat(string_split(given_names, ' ')[-1], ' ', coalesce(s, ''))) ELSE s END AS surname, given_names, {_second_sql('second', f'CASE WHEN p > 0 THEN {_MAP}[code] END')} FROM g)
SELECT src.id AS id, h.* EXCLUDE (id) FROM src LEFT JOIN h ON h.id = src.id""")
def answer_zone_fields(spark, sf_dir):
    return derive(spark, sf_dir, ANSWERS).select("id", zonetext.answer_fields(F.col("t"), STATES).alias("z")).select("id", *(F.col(f"z.{f}").alias(f) for f in zonetext.FIELDS))


@query(rf"""WITH src AS ({ANSWERS}), a AS (SELECT id, trim(regexp_replace(replace(replace(t, '班级：___', ''), '班级', ''), '\s+', ' ', 'g')) AS raw FROM src), u AS (SELECT *, upper(raw) AS u FROM a),
b AS (SELECT *, regexp_replace(replace(CASE WHEN contains(u, 'P<') THEN substr(u, instr(u, 'P<') + 2) WHEN contains(u, 'PPD<<') THEN substr(u, instr(u, 'PPD<<') + 5) WHEN contains(u, 'PP<') THEN substr(u, instr(u, 'PP<') + 3) END, '><', '<<'), '[^A-Z0-9<]', '', 'g') AS found FROM u),
c AS (SELECT *, [x for x in string_split(found, '<<') if x <> ''] AS sections FROM b WHERE found <> ''), d AS (SELECT *, CASE WHEN {_is_state('sections[1]')} THEN substr(sections[1], 1, 3) END AS code, [x for x in string_split(coalesce(sections[2], ''), '<') if x <> '' AND (NOT regexp_matches(x, '[0-9]') OR length(x) > 2)] AS given FROM c WHERE len(sections) > 0),
e AS (SELECT *, CASE WHEN code IS NULL THEN sections[1] ELSE substr(sections[1], 4) END AS base, coalesce(given[-1] IN ('AL', 'EL'), false) AS particle FROM d),
f AS (SELECT *, CASE WHEN particle AND base <> '' THEN concat(given[-1], ' ', base) ELSE base END AS s, code IS NOT NULL OR (base <> '' AND len(given) > 0 AND (regexp_matches(found, '[0-9]{{6}}[MF<][0-9]{{6}}') OR (particle AND length(base) <= 6))) AS trusted FROM e),
g AS (SELECT id, CASE WHEN regexp_matches(found, '{_SECOND}') THEN raw END AS mrz, CASE WHEN trusted THEN {_token('s')} END AS surname, CASE WHEN trusted THEN {_token("array_to_string(given, ' ')")} END AS given_names, {_second_sql('found', f'{_MAP}[code]')} FROM f)
SELECT src.id AS id, g.* EXCLUDE (id) FROM src LEFT JOIN g ON g.id = src.id""")
def zone_in_answer_fields(spark, sf_dir):
    return derive(spark, sf_dir, ANSWERS).select("id", zonetext.zone_in_text(F.col("t"), STATES).alias("z")).select("id", *(F.col(f"z.{f}").alias(f) for f in zonetext.FIELDS))


@query(rf"""WITH src AS ({ANSWERS}), texts AS (SELECT id, 1 AS k, t FROM src), {_zone_parts('texts')} SELECT src.id AS id, {', '.join(_ZONED)} FROM src LEFT JOIN zp ON zp.id = src.id""")
def service_zone_fields(spark, sf_dir):
    return derive(spark, sf_dir, ANSWERS).select("id", zonetext.service_zone(F.col("t")).alias("z")).select("id", *(F.col(f"z.{f}").alias(f) for f in _ZONED))


#: Flat answers: fields on lines, hints, numbers and zones in all combinations.
FLAT = """
SELECT c_custkey AS id, concat_ws(chr(10), CASE WHEN c_custkey % 2 = 0 THEN concat('Surname: ', c_mktsegment) END, CASE c_custkey % 3 WHEN 0 THEN 'given_names : Null' WHEN 1 THEN 'color: red' END, CASE c_custkey % 5 WHEN 0 THEN 'POCCИЙСКАЯ' WHEN 1 THEN 'fcedepaiia' END,
  CASE c_custkey % 7 WHEN 0 THEN concat('Document number: ab', CAST(c_custkey + 100000 AS STRING)) WHEN 1 THEN concat('no AB', lpad(CAST(c_custkey AS STRING), 7, '0')) WHEN 2 THEN concat('document_number: X', lpad(CAST(c_custkey AS STRING), 8, '0'), ' ') WHEN 3 THEN 'C12345678901' END, CASE c_custkey % 4 WHEN 0 THEN 'SEX: f' WHEN 1 THEN 'sex : M' WHEN 2 THEN 'unisex: F' END,
  CASE WHEN c_custkey % 11 = 0 THEN concat('P<RUS', c_mktsegment, '<<ANNA<<<<', chr(10), 'L', lpad(CAST(c_custkey AS STRING), 8, '0'), '6RUS7408122F3204159<<<<') WHEN c_custkey % 11 = 1 THEN concat('P<', c_mktsegment, '<<ANNA<AL') WHEN c_custkey % 11 = 2 THEN 'P<' END) AS t FROM customer"""
ALLOWED = ("document_number", "surname", "given_names", "nationality", "date_of_birth", "sex", "date_of_expiry", "mrz")


def _flat_sql() -> str:
    line = rf"[x for x in {_lines('t')} if regexp_matches(x, '^[A-Za-z_]+\s*:')]"
    flat = lambda f: rf"[v for v in [trim(regexp_extract(x, '^[A-Za-z_]+\s*:\s*(.*)$', 1)) for x in {line} if lower(regexp_extract(x, '^[A-Za-z_]+')) = '{f}'] if lower(v) NOT IN ('', 'null')][-1]"
    hint = "contains(u, 'POCC') OR contains(u, 'FCEDEPAIIA')"
    number = r"coalesce(nullif(regexp_extract(u, 'DOCUMENT[_\s]NUMBER\s*:\s*([A-Z0-9]{6,12})', 1), ''), nullif(regexp_extract(u, '\b([A-Z]{1,2}[0-9]{7,8})\b', 1), ''))"
    own = ", ".join(f"coalesce(f_{f}, " + (f"CASE WHEN z.id IS NOT NULL THEN z.{f} ELSE n_{f} END" if f in ("nationality", "document_number", "sex") else f"z.{f}") + f") AS {f}" for f in ALLOWED)
    return rf"""WITH src AS ({FLAT}), a0 AS (SELECT id, t, trim(regexp_replace(t, '\s+', ' ', 'g')) AS raw FROM src), a AS (SELECT *, upper(raw) AS u FROM a0),
b AS (SELECT *, regexp_replace(replace(CASE WHEN contains(u, 'P<') THEN substr(u, instr(u, 'P<') + 2) END, '><', '<<'), '[^A-Z0-9<]', '', 'g') AS found FROM a),
c AS (SELECT *, [x for x in string_split(found, '<<') if x <> ''] AS sections FROM b WHERE found <> ''), d AS (SELECT *, CASE WHEN {_is_state('sections[1]')} THEN substr(sections[1], 1, 3) END AS code, [x for x in string_split(coalesce(sections[2], ''), '<') if x <> '' AND (NOT regexp_matches(x, '[0-9]') OR length(x) > 2)] AS given FROM c WHERE len(sections) > 0),
e AS (SELECT *, CASE WHEN code IS NULL THEN sections[1] ELSE substr(sections[1], 4) END AS base, coalesce(given[-1] IN ('AL', 'EL'), false) AS particle FROM d),
f AS (SELECT *, CASE WHEN particle AND base <> '' THEN concat(given[-1], ' ', base) ELSE base END AS s, code IS NOT NULL OR (base <> '' AND len(given) > 0 AND (regexp_matches(found, '[0-9]{{6}}[MF<][0-9]{{6}}') OR (particle AND length(base) <= 6))) AS trusted FROM e),
g AS (SELECT id, CASE WHEN regexp_matches(found, '{_SECOND}') THEN raw END AS mrz, CASE WHEN trusted THEN {_token('s')} END AS surname, CASE WHEN trusted THEN {_token("array_to_string(given, ' ')")} END AS given_names, {_second_sql('found', f'{_MAP}[code]')} FROM f),
z AS (SELECT * FROM g WHERE coalesce(mrz, surname, given_names, nationality, document_number, date_of_birth, sex, date_of_expiry) IS NOT NULL),
w AS (SELECT id, {', '.join(f'{flat(f)} AS f_{f}' for f in ALLOWED)}, CASE WHEN {hint} THEN 'RUSSIAN FEDERATION' END AS n_nationality, {number} AS n_document_number, CASE WHEN {hint} OR {number} IS NOT NULL THEN nullif(regexp_extract(u, '\bSEX\s*:\s*([MF])\b', 1), '') END AS n_sex FROM a)
SELECT w.id AS id, {own} FROM w LEFT JOIN z ON z.id = w.id"""


@query(_flat_sql())
def flat_passport_fields(spark, sf_dir):
    m = derive(spark, sf_dir, FLAT).select("id", zonetext.flat_passport(F.col("t"), ALLOWED, STATES).alias("m"))
    return m.select("id", *(F.try_element_at("m", F.lit(f)).alias(f) for f in ALLOWED))


@query(rf"""WITH src AS ({LICENCES}), a AS (SELECT id, {_united_lines('number_text', 'said')} AS ls, [lpad(CAST(id AS VARCHAR), 7, '0'), '7654321'] AS ex FROM src)
SELECT id, {_fallback_number('ex')} AS number, {_ADDRESS} AS address, coalesce(array_to_string({_KINDS_ONCE}, ','), '') AS categories FROM a""")
def licence_lines(spark, sf_dir):
    """Numbers without a label, addresses under names and categories of the licences' lines."""
    said = derive(spark, sf_dir, LICENCES).select("id", text.distinct_lines(text.lines(F.concat_ws("\n", "number_text", "said"))).alias("ls"))
    ls, known = F.col("ls"), F.array(F.lpad(F.col("id").cast("string"), 7, "0"), F.lit("7654321"))
    return said.select("id", licence.fallback_number(ls, known).alias("number"), licence.address(ls).alias("address"), F.array_join(licence.categories(ls), ",").alias("categories"))


@query(rf"""WITH s AS ({FLAT}), l AS (SELECT id, unnest({_lines('t')}) AS x, generate_subscripts({_lines('t')}, 1) AS i FROM s), p AS (SELECT id, i, lower(regexp_extract(x, '^[A-Za-z_]+')) AS key, trim(regexp_extract(x, '^[A-Za-z_]+\s*:\s*(.*)$', 1)) AS value FROM l WHERE regexp_matches(x, '^[A-Za-z_]+\s*:'))
SELECT id, key, arg_max(value, i) AS value FROM p WHERE key IN ({', '.join(f"'{a}'" for a in ALLOWED)}) AND lower(value) NOT IN ('', 'null') GROUP BY id, key""")
def flat_answers(spark, sf_dir):
    f = derive(spark, sf_dir, FLAT)
    return f.select("id", F.explode(licence.flat_answer(text.lines(F.col("t")), ALLOWED)).alias("key", "value"))


#: Values of passport fields as recognition leaves them.
PARTS = """SELECT c_custkey AS id, concat(CASE c_custkey % 5 WHEN 0 THEN 'USA' WHEN 1 THEN concat('O', chr(39)) WHEN 2 THEN '12 ' WHEN 3 THEN 'usa' ELSE '' END, CASE c_custkey % 7 WHEN 0 THEN 'FARSI' WHEN 1 THEN '' WHEN 2 THEN lower(c_mktsegment) ELSE concat(c_mktsegment, '-', CAST(c_nationkey AS STRING)) END) AS surname,
  concat(CASE c_custkey % 4 WHEN 0 THEN 'Anna, Maria 7 date ' WHEN 1 THEN 'USAF' WHEN 2 THEN 'Place ' ELSE '' END, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END) AS given, concat(' ', CASE c_custkey % 4 WHEN 0 THEN 'CHICAGO ILINIOIS' WHEN 1 THEN 'ILLINIOIS, X' WHEN 2 THEN 'ILINOIS' ELSE c_mktsegment END, ' ') AS place,
  concat(CASE c_custkey % 9 WHEN 0 THEN 'Sex: m ' WHEN 1 THEN 'type F x' WHEN 2 THEN '(x)' WHEN 3 THEN 'MALE' WHEN 4 THEN 'الجنس ذكر' WHEN 5 THEN 'f1' WHEN 6 THEN 'sex/sexe : X' WHEN 7 THEN 'انثى m' ELSE '' END, CASE WHEN c_custkey % 2 = 0 THEN ' 5' ELSE '' END) AS sex,
  concat(CASE c_custkey % 6 WHEN 0 THEN 'Issuing  Authority: ' WHEN 1 THEN 'x AUTORIDAD United States Department of State, ' WHEN 2 THEN 'Autorite / ' WHEN 3 THEN 'AUTHORITY' WHEN 4 THEN 'authority - autoridad: ' ELSE '' END, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat(c_mktsegment, ' :') END) AS authority,
  concat(CASE c_custkey % 3 WHEN 0 THEN 'the United Arab Emirates' WHEN 1 THEN 'UNITED STATES OF AMERICA' ELSE 'none' END, CASE WHEN c_custkey % 5 = 0 THEN ' united arab emirates' ELSE '' END) AS country, concat(CASE c_custkey % 4 WHEN 0 THEN '1' ELSE '' END, lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0'), '/03/2019', CASE WHEN c_custkey % 3 = 0 THEN '1 04/05/2020' ELSE ', until' END) AS issued FROM customer"""
_OFFICE = "nullif(trim(regexp_replace(regexp_replace(regexp_replace(o, '^.*?AUTHORITY[^A-Z0-9a-z]*', '', 'i'), '^.*?AUTORIDAD[^A-Z0-9a-z]*', '', 'i'), '^.*?AUTORIT.{0,4}[^A-Z0-9a-z]*', '', 'i'), ' :-/'), '')"


@query(rf"""WITH a AS (SELECT *, trim(regexp_replace(upper(surname), '[^A-Z ]', '', 'g')) AS s, nullif(trim(regexp_replace(authority, '\s+', ' ', 'g')), '') AS o, regexp_replace(upper(sex), '[^A-Z]', '', 'g') AS letters FROM ({PARTS})),
b AS (SELECT *, CASE WHEN starts_with(s, 'USA') AND length(s) > 3 THEN substr(s, 4) ELSE s END AS t, {_OFFICE} AS p FROM a)
SELECT id, nullif(CASE WHEN t = 'FARSI' THEN 'AL FARSI' ELSE t END, '') AS surname, nullif(trim(regexp_replace(regexp_replace(regexp_replace(upper(given), '[^A-Z ]', ' ', 'g'), '\b(?:USAF|USA|ISSUE|DATE|BIRTH|PLACE|NATIONALITY|PASSPORT)\b', ' ', 'g'), ' +', ' ', 'g')), '') AS given_names,
replace(replace(replace(trim(place), 'ILINIOIS', 'ILLINOIS'), 'ILLINIOIS', 'ILLINOIS'), 'ILINOIS', 'ILLINOIS') AS place, CASE WHEN contains(sex, 'ذكر') THEN 'M' WHEN contains(sex, 'انث') OR contains(sex, 'أنث') THEN 'F' ELSE coalesce(nullif(regexp_extract(upper(sex), 'SEX[^A-Z0-9]*([MFX])(?:[^A-Z]|$)', 1), ''), nullif(regexp_extract(upper(sex), '\b([MFX])\b', 1), ''), CASE WHEN letters IN ('M', 'F', 'X') THEN letters END) END AS sex,
CASE WHEN contains(p, 'Department of State') THEN 'United States Department of State' ELSE p END AS authority, CASE WHEN contains(upper(country), 'UNITED ARAB EMIRATES') THEN 'ARE' WHEN contains(upper(country), 'UNITED STATES OF AMERICA') THEN 'USA' END AS nationality, nullif(regexp_extract(issued, '\b[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}\b'), '') AS issued FROM b""")
def passport_values(spark, sf_dir):
    c = F.col
    p = derive(spark, sf_dir, PARTS)
    return p.select("id", passport.surname(c("surname")).alias("surname"), passport.given_names(c("given")).alias("given_names"), passport.place_of_birth(c("place")).alias("place"), passport.sex_from_text(c("sex")).alias("sex"), passport.authority(c("authority")).alias("authority"), passport.nationality_of(c("country")).alias("nationality"), passport.issue_date(c("issued")).alias("issued"))


#: First lines, compact identity lines and zones within other text.
ZONE_VALUES = """SELECT c_custkey AS id, concat(CASE c_custkey % 6 WHEN 0 THEN 'P<UTO' WHEN 1 THEN 'p<al<' WHEN 2 THEN 'NO ZONE ' WHEN 3 THEN 'x P<' WHEN 4 THEN 'P<UT' ELSE 'PP<' END, CASE WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END, CASE c_custkey % 5 WHEN 0 THEN '<<ANNA<MARIA<<<' WHEN 1 THEN '<<' WHEN 2 THEN '<ANNA' WHEN 3 THEN '<<x1' ELSE '<<<LOU' END) AS line1,
  concat(CASE c_custkey % 4 WHEN 0 THEN '# ' WHEN 1 THEN 'no.' ELSE '' END, 'AB', lpad(CAST(c_custkey AS STRING), CASE WHEN c_custkey % 3 = 0 THEN 6 ELSE 7 END, '0'), CASE c_custkey % 7 WHEN 0 THEN ' UTO 12 03 1974 f 15.04.2031' WHEN 1 THEN '<6UTO7408122F1204159ZE' WHEN 2 THEN 'UTO120319Z4M15042031' WHEN 3 THEN '1UTO3001019X2912311' WHEN 4 THEN '' ELSE concat(' uto ', lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0'), '121990M01012025') END) AS compact,
  concat('short<', chr(10), CASE WHEN c_custkey % 3 = 1 THEN 'AAAAAAAAAAAAAAAAAAAA' ELSE repeat('A', CAST(15 + c_custkey % 7 AS INT)) END, CASE WHEN c_custkey % 2 = 0 THEN '<' ELSE '' END, chr(10), CASE WHEN c_custkey % 5 = 0 THEN '<<<<<<<<<<<<<<<<<<<<<<<' ELSE 'x' END) AS said FROM customer"""


def _zone_values_sql() -> str:
    name = lambda x: f"nullif(trim(replace({x}, '<', ' ')), '')"
    with_state, alone = "P<([A-Z]{3})([A-Z<]+?)<<([A-Z<]+)", "P<([A-Z<]+?)<<([A-Z<]+)"
    part = lambda p, i: f"regexp_extract(clean, '{p}', {i})"
    one = lambda i: f"CASE WHEN regexp_matches(clean, '{with_state}') THEN {name(part(with_state, i + 1))} WHEN regexp_matches(clean, '{alone}') THEN {name(part(alone, i))} END"
    long_, short = "([A-Z0-9]{8,9})([A-Z]{3})([0-9]{8})([MFX])([0-9]{8})", "([A-Z0-9]{8,9})[0-9]([A-Z]{3})([0-9]{6})[0-9]([MFX])([0-9]{6})"
    x = lambda p, i: f"regexp_extract(squashed, '{p}', {i})"
    slashed = lambda i: f"concat(substr({x(long_, i)}, 1, 2), '/', substr({x(long_, i)}, 3, 2), '/', substr({x(long_, i)}, 5, 4))"
    dotted = lambda i: f"concat(substr({x(short, i)}, 5, 2), '.', substr({x(short, i)}, 3, 2), '.', CASE WHEN TRY_CAST(substr({x(short, i)}, 1, 2) AS INT) >= 30 THEN '19' ELSE '20' END, substr({x(short, i)}, 1, 2))"
    either = lambda a, b: f"CASE WHEN regexp_matches(squashed, '{long_}') THEN {a} WHEN regexp_matches(squashed, '{short}') THEN {b} END"
    lines = "nullif(array_to_string([y for y in [trim(z) for z in string_split(said, chr(10))] if contains(y, '<') AND length(y) >= 20], ' '), '')"
    return f"""WITH z AS (SELECT *, regexp_replace(upper(line1), '[^A-Z<]', '', 'g') AS clean, regexp_replace(upper(compact), '[^A-Z0-9]', '', 'g') AS squashed FROM ({ZONE_VALUES}))
SELECT id, {one(1)} AS surname, {one(2)} AS given_names, {either(x(long_, 1), x(short, 1))} AS number, {either(slashed(3), dotted(3))} AS birth, {either(slashed(5), dotted(5))} AS expiry, {lines} AS zone FROM z"""


@query(_zone_values_sql())
def passport_zones(spark, sf_dir):
    c = F.col
    z = derive(spark, sf_dir, ZONE_VALUES).select("id", passport.name_from_zone(c("line1")).alias("n"), passport.compact_identity(c("compact"), 2025).alias("i"), passport.zone_text(text.lines(c("said"))).alias("zone"))
    return z.select("id", "n.surname", "n.given_names", c("i.document_number").alias("number"), c("i.date_of_birth").alias("birth"), c("i.date_of_expiry").alias("expiry"), "zone")
