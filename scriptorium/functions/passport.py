"""Passport text: fields from recognised lines, from a compact identity line and from a damaged first zone line. Null stays null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import dates, text
from scriptorium.functions.mrz import let
from scriptorium.functions.payload import EDGE_L, EDGE_R

#: Misspelt places and their spelling, in the order of replacement (fixed values).
PLACES = (("ILINIOIS", "ILLINOIS"), ("ILLINIOIS", "ILLINOIS"), ("ILINOIS", "ILLINOIS"))
#: Words that recognition adds to given names (fixed values).
NAME_NOISE = "USAF|USA|ISSUE|DATE|BIRTH|PLACE|NATIONALITY|PASSPORT"
#: Words of labels, which no line with a name holds (fixed values).
NAME_LABELS = ("UNITED", "COUNTRY", "CODE", "PASSPORT", "NAME", "NAMES", "NATIONALITY", "TYPE", "PLACE", "BIRTH")
#: Phrases that name a country, and its code (fixed values).
COUNTRY_PHRASES = (("UNITED ARAB EMIRATES", "ARE"), ("UNITED STATES OF AMERICA", "USA"))
#: Shapes of dates in running text (fixed values).
DIGIT_DATE = "[0-9]{2}[./-][0-9]{2}[./-][0-9]{2,4}"
NAMED_DATE = r"[0-9]{2}\s+[A-Z][a-z]{2}\s+[0-9]{4}"
#: First zone lines with and without a state, compact identity lines, sexes and labels of authorities (fixed values).
NAME_WITH_STATE, NAME_ALONE = "P<([A-Z]{3})([A-Z<]+?)<<([A-Z<]+)", "P<([A-Z<]+?)<<([A-Z<]+)"
COMPACT_LONG, COMPACT_ZONE = "([A-Z0-9]{8,9})([A-Z]{3})([0-9]{8})([MFX])([0-9]{8})", "([A-Z0-9]{8,9})[0-9]([A-Z]{3})([0-9]{6})[0-9]([MFX])([0-9]{6})"
LABELLED_SEX = "SEX[^A-Z0-9]*([MFX])(?:[^A-Z]|$)"
AUTHORITY_LABELS = ("AUTHORITY", "AUTORIDAD", "AUTORIT.{0,4}")


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def place_of_birth(c: Column) -> Column:
    out = text.strip(c)
    for wrong, right in PLACES:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def surname(c: Column) -> Column:
    """A-Z and blanks only, a leading USA dropped; null if nothing is left."""
    t = text.strip(F.regexp_replace(F.upper(c), "[^A-Z ]", ""))
    t = F.when(t.startswith("USA") & (F.length(t) > 3), F.substr(t, F.lit(4))).otherwise(t)
    return _some(F.when(t == "FARSI", "AL FARSI").otherwise(t))


def given_names(c: Column) -> Column:
    """A-Z words without label words; null if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z ]", " "), rf"\b(?:{NAME_NOISE})\b", " ")
    return _some(F.trim(F.regexp_replace(t, " +", " ")))


def sex_from_text(c: Column) -> Column:
    """M, F or X: by the Arabic words, after SEX, standing alone, or as the only letter."""
    u = F.upper(c)
    after = F.regexp_extract(u, LABELLED_SEX, 1)
    alone = F.regexp_extract(u, r"(?U)\b([MFX])\b", 1)
    letters = F.regexp_replace(u, "[^A-Z]", "")
    found = F.when(after != "", after).when(alone != "", alone).when(letters.isin("M", "F", "X"), letters)
    return F.when(c.contains("ذكر"), "M").when(c.contains("انث") | c.contains("أنث"), "F").otherwise(found)


def authority(c: Column) -> Column:
    """What stands behind the labels of an authority; null if nothing is left."""
    t = text.squash(c)
    for label in AUTHORITY_LABELS:
        t = F.regexp_replace(t, f"(?i)^.*?{label}[^A-Z0-9]*", "")
    t = F.btrim(t, F.lit(" :-/"))
    return F.when(t.contains("Department of State"), "United States Department of State").otherwise(_some(t))


def nationality_of(c: Column) -> Column:
    """The code of the first country phrase that the text holds; null without one."""
    out = F.lit(None).cast("string")
    for phrase, code in reversed(COUNTRY_PHRASES):
        out = F.when(F.upper(c).contains(phrase), code).otherwise(out)
    return out


def issue_date(c: Column) -> Column:
    return _some(F.regexp_extract(c, r"\b[0-9]{2}/[0-9]{2}/[0-9]{4}\b", 0))


def first_line(ls: Column, markers: tuple[str, ...]) -> Column:
    """The first line that holds a marker (in upper case); null without one."""
    return F.get(ls, (text.first_with(ls, markers) - 1).cast("int"))


def zone_text(ls: Column) -> Column:
    """Lines with < and 20 characters or more, joined by blanks; null without one."""
    return _some(F.array_join(F.filter(ls, lambda x: x.contains("<") & (F.length(x) >= 20)), " "))


def preview(c: Column, most: int = 500) -> Column:
    return F.left(c, F.lit(most))


def imported_zone(c: Column, width: int = 44) -> Column:
    """A zone on one line, in two: written breaks become real ones, and a line over the width is cut there. Blanks are squashed first."""
    t = F.replace(F.replace(text.squash(c), F.lit("\\r"), F.lit("\n")), F.lit("\\n"), F.lit("\n"))
    return text.strip(F.when(~t.contains("\n") & (F.length(t) > width), F.concat(F.left(t, F.lit(width)), F.lit("\n"), F.substr(t, F.lit(width + 1)))).otherwise(t))


def without_special(c: Column, tokens: tuple[str, ...] = ("<pad>", "<unk>", "<s>", "</s>")) -> Column:
    for t in tokens:
        c = F.replace(c, F.lit(t), F.lit(""))
    return text.strip(c)


def without_noise(c: Column, artefacts: tuple[str, ...] = ()) -> Column:
    """Literal artefacts dropped, written breaks made real, blanks and tabs squashed, ends trimmed."""
    for a in artefacts:
        c = F.replace(c, F.lit(a), F.lit(""))
    c = F.replace(F.replace(F.replace(c, F.lit("\\r"), F.lit("\n")), F.lit("\\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return text.strip(F.regexp_replace(c, "[ \t]+", " "))


def name_from_zone(c: Column) -> Column:
    """(surname, given_names) of a first zone line, with or without its issuing state; null if neither shape is there."""
    clean = F.regexp_replace(F.upper(c), "[^A-Z<]", "")
    whole, bare = NAME_WITH_STATE, NAME_ALONE
    name = lambda x: _some(F.trim(F.replace(x, F.lit("<"), F.lit(" "))))
    both = lambda p, i: F.struct(name(F.regexp_extract(clean, p, i)).alias("surname"), name(F.regexp_extract(clean, p, i + 1)).alias("given_names"))
    return F.when(clean.rlike(whole), both(whole, 2)).when(clean.rlike(bare), both(bare, 1))


def compact_identity(c: Column, this_year: int) -> Column:
    """Number, nationality, birth, sex and expiry from squashed text: dates of eight digits, else the shape of a second zone line; null without either."""
    t = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    long, zone = COMPACT_LONG, COMPACT_ZONE

    def fields(p: str, date) -> Column:
        part = lambda i: F.regexp_extract(t, p, i)
        return F.struct(part(1).alias("document_number"), part(2).alias("nationality"), date(part(3)).alias("date_of_birth"), part(4).alias("sex"), date(part(5)).alias("date_of_expiry"))

    return F.when(t.rlike(long), fields(long, dates.compact_slashes)).when(t.rlike(zone), fields(zone, lambda d: dates.mrz_dotted(d, 30)))


def name_line(ls: Column) -> Column:
    """(surname, given_names) of the first line that reads like a name: two words or more, one with a small letter, no label word; its last word is the surname."""

    def words(line: Column) -> Column:
        return F.filter(F.split(F.trim(F.regexp_replace(F.replace(line, F.lit("/"), F.lit(" ")), f"{text.WS}+", " ")), " "), lambda w: w.rlike(r"\A[A-Za-z-]+\z"))

    named = F.filter(F.transform(ls, words), lambda ws: (F.size(ws) >= 2) & ~F.exists(ws, lambda w: F.upper(w).isin(*NAME_LABELS)) & F.exists(ws, lambda w: w.rlike("[a-z]")))
    spaced = lambda x: F.trim(F.upper(F.replace(x, F.lit("-"), F.lit(" "))))

    def split(ws: Column) -> Column:
        return F.struct(spaced(F.element_at(ws, -1)).alias("surname"), _some(spaced(F.array_join(F.slice(ws, F.lit(1), F.size(ws) - 1), " "))).alias("given_names"))

    # a line whose last word is only hyphens has no surname
    found = F.filter(named, lambda ws: spaced(F.element_at(ws, -1)) != "")
    return let(F.get(found, F.lit(0)), lambda ws: F.when(ws.isNotNull(), split(ws)))


def dates_in(c: Column) -> Column:
    """All dates of a text, in order: two digits each for day and month with . / or -, two to four for the year, or a day, a month's short name and a year."""
    return F.regexp_extract_all(c, F.lit(rf"{EDGE_L}(?:{DIGIT_DATE}|{NAMED_DATE}){EDGE_R}"), F.lit(0))


def ordinal_dates(c: Column) -> Column:
    """(birth, issue, expiry): the first, second and third date of a text; of two dates the second is the expiry too, a single one is only the birth."""
    return let(dates_in(c), lambda found: F.struct(F.get(found, F.lit(0)).alias("birth"), F.get(found, F.lit(1)).alias("issue"), F.when(F.size(found) >= 2, F.coalesce(F.get(found, F.lit(2)), F.get(found, F.lit(1)))).alias("expiry")))
