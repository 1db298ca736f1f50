"""Tolerant readers of zones in free text: that of the recognition service, that of answers with two lines, and that of answers in which a zone stands somewhere, as Column expressions. Null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import dates, gates, licence, text
from scriptorium.functions.mrz import WIDTH, let

#: Patterns of zones, of damaged Russian text and of flat answers (fixed values).
FIRST_LINE = "P<[A-Z<]{20,}"
WITH_STATE = "^P<[A-Z]{3}[A-Z<]*<<"
SECOND_LINE = "([A-Z0-9<]{9})[0-9<]([A-Z<]{3})([0-9]{6})[0-9<]([MF<])([0-9]{6})"
SECOND_SIGNAL = "[0-9]{6}[MF<][0-9]{6}"
PREFIXES = ("PPD<<", "P<", "PP<", "P")
MARKERS = ("P<", "PPD<<", "PP<")
PARTICLES = ("AL", "EL")
RUSSIAN_HINTS = ("POCC", "POCCH", "FCEDEPAIIA", "POCCИЙСКАЯ")
FLAT_NUMBER = r"DOCUMENT[_\s]NUMBER\s*:\s*([A-Z0-9]{6,12})"
BARE_NUMBER = "([A-Z]{1,2}[0-9]{7,8})"
FLAT_SEX = r"SEX\s*:\s*([MF])"
#: What a recogniser adds to its answers (fixed values).
ARTEFACTS = ("班级：___", "班级")

FIELDS = ("mrz", "surname", "given_names", "nationality", "document_number", "date_of_birth", "sex", "date_of_expiry")


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _zone(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9<]", "")


def _fit(c: Column) -> Column:
    return F.rpad(F.left(c, F.lit(WIDTH)), WIDTH, "<")


def _raw_lines(c: Column) -> Column:
    return F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def service_zone(c: Column) -> Column:
    """Seven fields of a zone as the recognition service reads it: a first line is sought in the joined text, a second one is the next line or what follows; its fields count only if it looks like one. Null if no first line is there."""
    found = F.filter(F.transform(_raw_lines(c), _zone), lambda x: x != "")

    def whole(ls: Column) -> Column:
        joined, second = F.array_join(ls, ""), F.get(ls, F.lit(1))
        first = F.regexp_extract(joined, FIRST_LINE, 0)
        rest = F.substr(joined, F.instr(joined, first) + F.length(first))
        both = F.when(first != "", F.struct(_fit(first).alias("l1"), F.when(second.isNotNull(), _fit(second)).when(rest != "", _fit(rest)).alias("l2"))).otherwise(F.struct(_fit(F.get(ls, F.lit(0))).alias("l1"), F.when(second.isNotNull(), _fit(second)).alias("l2")))
        return let(both, fields)

    def fields(p: Column) -> Column:
        l1, l2 = p["l1"], p["l2"]
        part = F.substr(l1, F.when(l1.rlike(WITH_STATE), 6).otherwise(3))
        cut = F.split(part, "<<", 2)
        name = lambda x: _some(F.trim(F.replace(x, F.lit("<"), F.lit(" "))))
        named = F.contains(part, F.lit("<<"))
        ok = gates.like_second_line(l2)
        plain = lambda i, n: F.when(ok, _some(F.replace(F.substring(l2, i, n), F.lit("<"), F.lit(""))))
        date = lambda i: F.when(ok, dates.mrz_dotted(F.replace(F.substring(l2, i, 6), F.lit("<"), F.lit("")), 30))
        out = F.struct(F.when(named, name(F.get(cut, F.lit(0)))).alias("surname"), F.when(named, name(F.get(cut, F.lit(1)))).alias("given_names"), plain(11, 3).alias("nationality"), date(14).alias("date_of_birth"), plain(21, 1).alias("sex"), date(22).alias("date_of_expiry"), plain(1, 9).alias("document_number"))
        return F.when(l1.startswith("P<"), out)

    return let(found, whole)


def _known(countries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in (countries or {"": ""}).items() for x in pair))


def name_token(c: Column) -> Column:
    """Fillers as blanks, A-Z with ' and - kept, blanks squashed; null if nothing is left."""
    return _some(F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z' -]+", " "), " +", " ")))


def _second(found: Column, known: Column, state: Column) -> dict[str, Column]:
    """Fields of a second line that stands somewhere in a text; state is the nationality that the first line gave."""
    part = lambda i: F.regexp_extract(found, SECOND_LINE, i)
    here = found.rlike(SECOND_LINE)
    plain = lambda i: F.replace(part(i), F.lit("<"), F.lit(""))
    nation = F.coalesce(F.try_element_at(known, plain(2)), F.try_element_at(known, part(2)))
    when = lambda c: F.when(here, c)
    return {
        "nationality": F.coalesce(state, when(nation)),
        "document_number": when(F.when(plain(1).rlike("[0-9]"), plain(1))),
        "date_of_birth": when(dates.mrz_dotted(part(3), 50)),
        "sex": when(F.when(plain(4).isin("M", "F"), plain(4))),
        "date_of_expiry": when(dates.mrz_dotted(part(5), 50)),
    }


def _struct(values: dict[str, Column]) -> Column:
    return F.struct(*(values[f].cast("string").alias(f) for f in FIELDS))


def answer_fields(c: Column, countries: dict[str, str]) -> Column:
    """FIELDS of an answer of one or two zone lines, with recovery: German and doubled prefixes, a lost P before a known state, doubled fillers, and the particles AL and EL moved from the given names to the surname where the state is unknown. Null without lines; countries maps codes to names."""
    known = _known(countries)
    is_state = lambda x: F.map_contains_key(known, F.left(x, F.lit(3))) & (F.length(x) >= 3)

    def without_prefix(line: Column) -> Column:
        out = line
        for p in reversed(PREFIXES):
            out = F.when(line.startswith(p), F.substr(line, F.lit(len(p) + 1))).otherwise(out)
        return out

    def recovered(x: Column) -> Column:
        one, two = F.substr(x, F.lit(2)), F.substr(x, F.lit(3))
        return F.when(x.startswith("<<"), F.when(is_state(two), two).otherwise(x)).when(x.startswith("<") & is_state(one), one).otherwise(x)

    def fields(p: Column) -> Column:
        ls, x = p["ls"], p["x"]
        code = F.when(is_state(x), F.left(x, F.lit(3)))
        payload = F.when(code.isNotNull(), F.substr(x, F.lit(4))).otherwise(x)
        cut, named = F.split(payload, "<<", 2), F.contains(payload, F.lit("<<"))
        given, surname = F.when(named, name_token(F.get(cut, F.lit(1)))), F.when(named, name_token(F.get(cut, F.lit(0))))
        last = F.element_at(F.split(given, " "), -1)
        moved = F.when(code.isNull() & last.isin(*PARTICLES), F.concat_ws(" ", last, surname)).otherwise(surname)
        state = F.when(named, F.try_element_at(known, code))
        second = F.coalesce(_some(F.get(ls, F.lit(1))), F.get(ls, F.lit(0)))
        return _struct({"mrz": F.array_join(ls, "\n"), "surname": moved, "given_names": given} | _second(second, known, state))

    found = F.transform(F.filter(_raw_lines(c), lambda x: text.strip(x) != ""), _zone)
    return F.when(_some(c).isNotNull(), let(found, lambda ls: F.when(F.size(ls) > 0, let(F.struct(ls.alias("ls"), let(without_prefix(F.get(ls, F.lit(0))), recovered).alias("x")), fields))))


def cleaned(c: Column) -> Column:
    """A generated answer without artefacts, blanks squashed; empty stays empty."""
    for a in ARTEFACTS:
        c = F.replace(c, F.lit(a), F.lit(""))
    return F.coalesce(text.squash(c), F.when(c.isNotNull(), F.lit("")))


def zone_in_text(c: Column, countries: dict[str, str]) -> Column:
    """FIELDS of a zone that stands somewhere in an answer: text from a marker on is cut at << into sections; short tokens with digits are dropped from the given names, a particle at their end also goes before the surname, and names without a known state count only with a second line or a particle and a short surname. mrz is the cleaned answer where a second line is there. Null if nothing is found."""
    known = _known(countries)

    def payload(u: Column) -> Column:
        from_marker = lambda m: F.when(F.contains(u, F.lit(m)), F.substr(u, F.instr(u, m) + len(m)))
        return F.regexp_replace(F.replace(F.coalesce(*map(from_marker, MARKERS)), F.lit("><"), F.lit("<<")), "[^A-Z0-9<]", "")

    def fields(p: Column) -> Column:
        raw, found = p["raw"], p["found"]
        sections = F.filter(F.split(found, "<<"), lambda s: s != "")
        first = F.get(sections, F.lit(0))
        code = F.when((F.length(first) >= 3) & F.map_contains_key(known, F.left(first, F.lit(3))), F.left(first, F.lit(3)))
        base = F.when(code.isNotNull(), F.substr(first, F.lit(4))).otherwise(first)
        tokens = F.filter(F.split(F.coalesce(F.get(sections, F.lit(1)), F.lit("")), "<"), lambda t: (t != "") & (~t.rlike("[0-9]") | (F.length(t) > 2)))
        names = F.struct(raw.alias("raw"), found.alias("found"), code.alias("code"), base.alias("base"), tokens.alias("tokens"))
        return F.when(F.size(sections) > 0, let(names, chosen))

    def chosen(n: Column) -> Column:
        code, base, tokens, found = n["code"], n["base"], n["tokens"], n["found"]
        last = F.try_element_at(tokens, F.lit(-1))
        particle = F.coalesce(last.isin(*PARTICLES), F.lit(False))
        surname = F.when(particle & (base != "") & ~base.startswith(F.concat(last, F.lit(" "))), F.concat_ws(" ", last, base)).otherwise(base)
        trusted = code.isNotNull() | ((base != "") & (F.size(tokens) > 0) & (found.rlike(SECOND_SIGNAL) | (particle & (F.length(base) <= 6))))
        mrz = F.when(found.rlike(SECOND_LINE), n["raw"])
        values = {"mrz": mrz, "surname": F.when(trusted, name_token(surname)), "given_names": F.when(trusted, name_token(F.array_join(tokens, " ")))} | _second(found, known, F.try_element_at(known, code))
        return let(_struct(values), lambda s: F.when(F.coalesce(*(s[f] for f in FIELDS)).isNotNull(), s))

    both = let(cleaned(c), lambda raw: F.struct(raw.alias("raw"), payload(F.upper(raw)).alias("found")))
    return let(both, lambda p: F.when(_some(p["found"]).isNotNull(), fields(p)))


def without_zone(c: Column) -> Column:
    """(nationality, document_number, sex) of an answer without a zone: by damaged Russian words, by a flat line or the shape of a passport number; the sex only beside one of them."""
    upper = F.upper(cleaned(c))
    edge = lambda p: licence.EDGE_L + p + licence.EDGE_R

    def fields(u: Column) -> Column:
        hint = F.lit(False)
        for h in RUSSIAN_HINTS:
            hint = hint | F.contains(u, F.lit(h))
        nation = F.when(hint, "RUSSIAN FEDERATION")
        number = F.coalesce(_some(F.regexp_extract(u, FLAT_NUMBER, 1)), _some(F.regexp_extract(u, edge(BARE_NUMBER), 1)))
        sex = F.when(nation.isNotNull() | number.isNotNull(), _some(F.regexp_extract(u, edge(FLAT_SEX), 1)))
        return F.struct(nation.alias("nationality"), number.alias("document_number"), sex.alias("sex"))

    return let(upper, fields)


def flat_passport(c: Column, allowed: tuple[str, ...], countries: dict[str, str]) -> Column:
    """Map of a flat answer: its `key: value` lines, then what a zone in it tells, or without any such field the fallback without a zone."""

    def merged(p: Column) -> Column:
        zone, bare = p["zone"], p["bare"]
        of = lambda s, names: F.array(*(F.struct(F.lit(f).alias("key"), s[f].alias("value")) for f in names))
        more = F.when(zone.isNotNull(), of(zone, FIELDS)).otherwise(of(bare, ("nationality", "document_number", "sex")))
        new = F.filter(more, lambda e: e["value"].isNotNull() & ~F.map_contains_key(p["flat"], e["key"]))
        return F.map_concat(p["flat"], F.map_from_entries(new))

    parts = F.struct(licence.flat_answer(text.lines(c), allowed).alias("flat"), zone_in_text(c, countries).alias("zone"), without_zone(c).alias("bare"))
    return F.when(c.isNotNull(), let(parts, merged))
