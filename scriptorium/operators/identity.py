"""Records of identity documents from recognised text: passports, identity cards and driver licences.

Each parser is a table of ranked rules over what its sources say (functions/rules.py). Stages are projections one after another, so that
what several rules use is worked out once; nothing is shuffled. Rows keep all their columns, whatever their names, and get the
result as a struct: fields, sources (which source gave a field), populated, is_valid, code, severity. Null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import dates, gates, licence, passport, text, zonetext
from scriptorium.functions.mrz import let
from scriptorium.functions.payload import EDGE_L, EDGE_R
from scriptorium.functions.rules import Rule, compiled, record, verdict

#: Labels before a value, by field (fixed values).
PASSPORT_LABELS = {
    "given_names": ("GIVEN NAMES",), "nationality": ("NATIONALITY",), "place_of_birth": ("LIEU DE NAISSANCE", "LUGAR DE NACIMIENTO", "PLANO / PLANO"), "date_of_birth": ("DATE OF BIRTH", "DATE OF BIRTH /"),
    "date_of_issue": ("DATE OF ISUS", "DATE OF ISSUE", "DATE OF DE"), "date_of_expiry": ("DATE OF EXPIRATION", "DATE OF EXPIRY"), "issuing_authority": ("DEPARTMENT OF STATE", "AUTHORITY", "AUTORITE"),
}
CORE_LABELS = {
    "given_names": ("GIVEN NAMES", "GIVEN NAME", "FIRST NAME", "PRENOMS", "NAMES"), "surname": ("SURNAME", "NOM", "LAST NAME", "FAMILY NAME"), "nationality": ("NATIONALITY", "NATIONALIT", "CITIZENSHIP"),
    "date_of_birth": ("DATE OF BIRTH", "BIRTH", "DOB", "NAISSANCE"), "date_of_issue": ("DATE OF ISSUE", "ISSUE DATE", "DATE OF ISUS", "DELIVERED"),
    "date_of_expiry": ("DATE OF EXPIRY", "EXPIRY DATE", "VALID UNTIL", "EXPIRATION"), "issuing_authority": ("AUTHORITY", "ISSUED BY", "AUTORITE", "DEPARTMENT"),
}
CARD_LABELS = {"address": ("ADDRESS", "ADRESSE", "ADDRESS /", "DOMICILE"), "personal_number": ("PERSONAL NUMBER", "PERSONALNO", "PIN", "IDENTIFICATION NO"), "sex": ("SEX", "SEXE", "GENDER")}
LICENCE_LABELS = {
    "surname": ("LN", "LAST NAME", "SURNAME"), "given_names": ("FN", "FIRST NAME", "GIVEN NAME", "GIVEN NAMES"), "date_of_birth": ("DOB", "DATE OF BIRTH", "BIRTH"), "date_of_issue": ("ISS", "ISSUED", "DATE OF ISSUE"),
    "date_of_expiry": ("EXP", "EXPIRY", "EXPIRATION"), "address": ("ADDRESS", "ADRESSE", "RESIDENCE", "DOMICILE"), "place_of_birth": ("PLACE OF BIRTH", "LIEU DE NAISSANCE", "LUGAR DE NACIMIENTO"),
}
PASSPORT_FIELDS = ["document_number", "surname", "given_names", "nationality", "date_of_birth", "sex", "place_of_birth", "date_of_issue", "date_of_expiry", "issuing_authority", "mrz"]
CARD_FIELDS = ["document_number", "surname", "given_names", "nationality", "date_of_birth", "sex", "address", "personal_number", "date_of_issue", "date_of_expiry", "issuing_authority"]
LICENCE_FIELDS = ["license_number", "surname", "given_names", "date_of_birth", "place_of_birth", "address", "date_of_issue", "date_of_expiry", "issuing_authority"]
#: Shapes of dates and numbers in running text (fixed values).
NAMED_DATE = rf"{EDGE_L}[0-9]{{2}}\s+[A-Z][a-z]{{2}}\s+[0-9]{{4}}{EDGE_R}"
EIGHT_DIGITS = f"{EDGE_L}[0-9]{{8,9}}{EDGE_R}"
NUMBER_TOKEN = f"{EDGE_L}[A-Z0-9]{{6,12}}{EDGE_R}"


def most_frequent(tokens: Column) -> Column:
    """The most frequent item of an array, the smallest among equals; null without items."""
    return let(tokens, lambda ts: F.array_min(F.transform(F.array_distinct(ts), lambda t: F.struct((-F.size(F.filter(ts, lambda x: x == t))).alias("n"), t.alias("v"))))["v"])


def _opened(df: DataFrame, **sources: str | None) -> DataFrame:
    """The row as one struct, and the sources under their own names; a missing source is null."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(F.col(f"`{c}`").cast("string").alias(name) if c else F.lit(None).cast("string").alias(name) for name, c in sources.items()))


def _closed(stages: DataFrame, df: DataFrame, result: Column, populated: Column, good: str, poor: str, into: str) -> DataFrame:
    done = stages.select("row", result.alias("r"), populated.alias("n"))
    whole = F.struct("r.*", F.col("n").alias("populated"), verdict(F.col("n"), good, poor)["is_valid"].alias("is_valid"), verdict(F.col("n"), good, poor)["code"].alias("code"), verdict(F.col("n"), good, poor)["severity"].alias("severity"))
    return done.select(*(F.col("row")[c].alias(c) for c in df.columns), whole.alias(into))


def _count(values: list[Column]) -> Column:
    return sum((F.when(F.coalesce(text.strip(v), F.lit("")) != "", 1).otherwise(0) for v in values), F.lit(0))


def _label(field: str, labels: dict[str, tuple[str, ...]], ls: str = "ls") -> Column:
    return text.value_after(F.col(ls), labels[field])


def _nth(n: int, least: int) -> Column:
    return F.when(F.size("found") >= least, F.get("found", F.lit(n)))


def passports(df: DataFrame, said: str, zone: str | None = None, names: str | None = None, sex: str | None = None, authority: str | None = None, into: str = "record") -> DataFrame:
    """df with a passport record from the page's text and, where they are read apart, its zone, name field, sex and authority."""
    s = _opened(df, said=said, zone=zone, names=names, sex=sex, authority=authority)
    said_ = F.coalesce("said", F.lit(""))
    office = F.nullif(F.btrim(text.squash(F.array_join(text.lines(F.col("authority")), " ")), F.lit(" :")), F.lit(""))
    s = s.select("row", said_.alias("said"), text.lines(said_).alias("ls"), text.lines(F.coalesce("names", F.lit(""))).alias("nls"), F.nullif(text.strip(F.col("zone")), F.lit("")).alias("zone"), "sex", office.alias("office"))
    s = s.select("*", F.coalesce(passport.zone_text(F.col("ls")), "zone").alias("joined"), zonetext.service_zone(F.col("zone")).alias("z1"), passport.compact_identity(F.col("said"), 0).alias("compact"), F.regexp_extract_all("said", F.lit(NAMED_DATE), F.lit(0)).alias("found"), passport.name_line(F.col("nls")).alias("crop"))
    s = s.select("*", zonetext.service_zone(F.col("joined")).alias("z2"))
    zoned = ("surname", "given_names", "nationality", "date_of_birth", "sex", "date_of_expiry", "document_number")
    first = _count([F.col(f"z1.{f}") for f in zoned]) >= _count([F.col(f"z2.{f}") for f in zoned])
    s = s.select("*", F.when(first, F.struct(F.col("zone").alias("t"), F.col("z1").alias("z"))).otherwise(F.struct(F.col("joined").alias("t"), F.col("z2").alias("z"))).alias("best"))
    s = s.select("*", passport.name_from_zone(F.col("best.t")).alias("line1"), licence.surname_before(F.col("ls")).alias("guess"), licence.surname_before(F.col("nls")).alias("guess2"))
    c, z = F.col, lambda f: F.col(f"best.z.{f}")
    short = c("guess").isNotNull() & (F.length("guess") <= 4)
    current = F.coalesce("line1.surname", z("surname"), F.when(short, c("guess2")), "guess")
    letters = F.length(F.regexp_replace(F.upper(current), "[^A-Z]", ""))
    at = lambda f, ls="ls": _label(f, PASSPORT_LABELS, ls)
    rules = [
        Rule("document_number", "zone", z("document_number"), gates.plausible_number(z("document_number"))),
        Rule("document_number", "compact", c("compact.document_number"), gates.plausible_number(c("compact.document_number"))),
        Rule("document_number", "text", most_frequent(F.regexp_extract_all("said", F.lit(EIGHT_DIGITS), F.lit(0)))),
        Rule("surname", "names", c("crop.surname"), current.isNull() | (letters <= 2)),
        Rule("surname", "line1", c("line1.surname")), Rule("surname", "zone", z("surname")), Rule("surname", "names_before", c("guess2"), short), Rule("surname", "text", c("guess")),
        Rule("given_names", "line1", c("line1.given_names")), Rule("given_names", "zone", z("given_names")), Rule("given_names", "text", at("given_names")), Rule("given_names", "names_label", at("given_names", "nls")), Rule("given_names", "names", c("crop.given_names")),
        Rule("nationality", "zone", z("nationality"), gates.plausible_nationality(z("nationality"))), Rule("nationality", "compact", c("compact.nationality"), gates.plausible_nationality(c("compact.nationality"))),
        Rule("nationality", "text", at("nationality")), Rule("nationality", "phrase", passport.nationality_of(c("said"))),
        Rule("date_of_birth", "zone", z("date_of_birth")), Rule("date_of_birth", "compact", c("compact.date_of_birth")), Rule("date_of_birth", "text", at("date_of_birth")), Rule("date_of_birth", "place", _nth(0, 1)),
        Rule("date_of_issue", "text", at("date_of_issue")), Rule("date_of_issue", "authority", passport.issue_date(c("office"))), Rule("date_of_issue", "place", _nth(1, 2)),
        Rule("date_of_expiry", "zone", z("date_of_expiry")), Rule("date_of_expiry", "compact", c("compact.date_of_expiry")), Rule("date_of_expiry", "text", at("date_of_expiry")), Rule("date_of_expiry", "place", F.coalesce(_nth(2, 3), _nth(1, 2))),
        Rule("sex", "zone", z("sex"), gates.plausible_sex(z("sex"))), Rule("sex", "compact", c("compact.sex"), gates.plausible_sex(c("compact.sex"))), Rule("sex", "text", passport.sex_from_text(F.coalesce(F.nullif("sex", F.lit("")), "office"))),
        Rule("place_of_birth", "text", passport.place_of_birth(at("place_of_birth"))),
        Rule("issuing_authority", "authority", passport.authority(c("office")), c("office").isNotNull(), last=True), Rule("issuing_authority", "text", passport.first_line(c("ls"), PASSPORT_LABELS["issuing_authority"])),
        Rule("mrz", "zone", c("best.t")),
    ]
    s = s.select("row", compiled(rules).alias("chosen"))
    useful = lambda x: let(x, lambda v: F.when(gates.useful_name(v), v))
    names_ = {"surname": useful(passport.surname(c("chosen.surname.value"))), "given_names": useful(passport.given_names(c("chosen.given_names.value")))}
    s = s.select("row", record("chosen", PASSPORT_FIELDS, names_).alias("r"))
    return _closed(s, df, c("r"), _count([c(f"r.fields.{f}") for f in PASSPORT_FIELDS]), "heuristic_passport_mapping", "passport_mapping_low_confidence", into)


def _core_rules() -> list[Rule]:
    """Rules over ls (lines) and found (dates of their joined text) that cards and licences share."""
    at = lambda f: _label(f, CORE_LABELS)
    return [
        Rule("document_number", "token", most_frequent(F.regexp_extract_all(F.array_join("ls", " "), F.lit(NUMBER_TOKEN), F.lit(0)))),
        Rule("surname", "label", at("surname")), Rule("surname", "before", licence.surname_before(F.col("ls")), at("given_names").isNotNull()),
        Rule("given_names", "label", at("given_names")), Rule("nationality", "label", at("nationality")),
        Rule("date_of_birth", "label", at("date_of_birth")), Rule("date_of_birth", "place", _nth(0, 1)),
        Rule("date_of_issue", "label", at("date_of_issue")), Rule("date_of_issue", "place", _nth(1, 2)),
        Rule("date_of_expiry", "label", at("date_of_expiry")), Rule("date_of_expiry", "place", F.coalesce(_nth(2, 3), _nth(1, 2))),
        Rule("issuing_authority", "line", passport.first_line(F.col("ls"), CORE_LABELS["issuing_authority"])),
    ]


def id_cards(df: DataFrame, said: str, into: str = "record") -> DataFrame:
    """df with an identity card's record."""
    s = _opened(df, said=said).select("row", text.lines(F.coalesce("said", F.lit(""))).alias("ls"))
    s = s.select("*", passport.dates_in(F.array_join("ls", " ")).alias("found"))
    rules = _core_rules() + [Rule(f, "label", _label(f, CARD_LABELS)) for f in ("address", "personal_number", "sex")]
    s = s.select("row", compiled(rules).alias("chosen")).select("row", record("chosen", CARD_FIELDS).alias("r"))
    return _closed(s, df, F.col("r"), _count([F.col(f"r.fields.{f}") for f in CARD_FIELDS]), "heuristic_id_card_mapping", "identity_mapping_low_confidence", into)


def driver_licences(df: DataFrame, sources: list[str], into: str = "record") -> DataFrame:
    """df with a driver licence's record; sources are columns of recognised text, the most trusted first. Their lines are united in order, each once in its first spelling. categories is an array beside the fields."""
    named = {f"t{i}": c for i, c in enumerate(sources)}
    s = _opened(df, **named)
    united = text.distinct_lines(F.concat(*(text.lines(F.coalesce(n, F.lit(""))) for n in named)))
    s = s.select("row", united.alias("ls"))
    s = s.select("*", passport.dates_in(F.array_join("ls", " ")).alias("found"))
    beside = lambda f: text.same_or_next(F.col("ls"), LICENCE_LABELS[f])
    core = _core_rules()
    rules = [Rule(f, "beside", beside(f)) for f in ("surname", "given_names", "date_of_birth", "date_of_issue", "date_of_expiry")] + core
    rules += [Rule("address", "label", _label("address", LICENCE_LABELS)), Rule("address", "after_name", licence.address(F.col("ls"))), Rule("place_of_birth", "label", _label("place_of_birth", LICENCE_LABELS))]
    s = s.select("row", "ls", compiled(rules).alias("one"))
    ls, v = F.col("ls"), lambda f: F.col(f"one.{f}.value")
    known = F.array_compact(F.array(*(F.nullif(F.regexp_replace(v(f), "[^0-9]", ""), F.lit("")) for f in ("date_of_birth", "date_of_expiry"))))
    missing = v("date_of_issue").isNull() | F.upper(v("date_of_issue")).startswith("DD ")
    s = s.select("*", licence.number(ls, known).alias("number"), F.when(missing, F.coalesce(dates.issue_date(ls, text.strip(v("date_of_birth")), text.strip(v("date_of_expiry"))), v("date_of_issue"))).otherwise(v("date_of_issue")).alias("issue"))
    s = s.select("*", *(dates.identity_date(text.strip(x), ls).alias(n) for x, n in ((v("date_of_birth"), "birth_"), (F.col("issue"), "issue_"), (v("date_of_expiry"), "expiry_"))))
    s = s.withColumn("birth_", F.when(F.col("birth_").isNull() | (F.col("birth_") == F.col("issue_")), F.coalesce(dates.birth_date(ls, F.col("issue_"), F.col("expiry_")), "birth_")).otherwise(F.col("birth_")))
    s = s.withColumn("issue_", F.when(F.col("issue_").eqNullSafe(F.col("birth_")), dates.issue_date(ls, F.col("birth_"), F.col("expiry_"))).otherwise(F.col("issue_")))
    late = F.coalesce(dates.ordinal(F.col("issue_")) > dates.ordinal(F.col("expiry_")), F.lit(False))
    s = s.withColumn("issue_", F.when(~late, F.col("issue_")))
    chosen = F.coalesce("number", v("document_number"))
    digits = F.array_compact(F.array(*(F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")) for c in ("birth_", "expiry_"))))
    useful = lambda x: let(x, lambda n: F.when(gates.useful_name(n), n))
    values = {"license_number": licence.normal_number(chosen, ls, digits), "surname": useful(text.identity_name(v("surname"))), "given_names": useful(text.identity_name(v("given_names"))), "date_of_birth": F.col("birth_"), "date_of_issue": F.col("issue_"), "date_of_expiry": F.col("expiry_")}
    values |= {f: v(f) for f in ("place_of_birth", "address", "issuing_authority")}
    s = s.select("row", F.struct(*(values[f].alias(f) for f in LICENCE_FIELDS), licence.categories(ls).alias("categories")).alias("fields"))
    populated = _count([F.col(f"fields.{f}") for f in LICENCE_FIELDS]) + F.coalesce(F.size("fields.categories"), F.lit(0))
    return _closed(s, df, F.struct("fields"), populated, "heuristic_driver_license_mapping", "identity_mapping_low_confidence", into)
