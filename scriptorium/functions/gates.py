"""Predicates that decide whether a record or a value may pass. Null inputs give false, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import text

#: Fragments of labels and boilerplate that no value should hold (fixed values).
SUSPICIOUS = ("signature", "holder", "http://", "https://", "issuing authority", "the following is a sample", "class", "end none")
#: Label words that are no name (fixed values).
NO_NAMES = ("NO", "OF", "ISSUE", "DATE OF", "DATE", "BIRTH", "PLACE", "PASSPORT", "AUTHORITY", "UNITED")
#: Shape of a second zone line (fixed value).
SECOND_LINE = r"\A[A-Z0-9<]{9}[0-9][A-Z]{3}[0-9]{6}[MFX<][0-9]{6}"


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_template(flag: Column) -> Column:
    """Whether the row is marked as a template; null is not."""
    return _true(flag)


def is_real_record(template: Column, image_exists: Column, populated: Column, least: int = 4) -> Column:
    """No template, its image is there and `least` fields or more are filled. populated is null where fields is no object."""
    return ~is_template(template) & _true(image_exists) & _true(populated >= least)


def is_from(source: Column, nationality: Column, token: str, country: str) -> Column:
    """The source holds the token (lower case), or the nationality is the country (upper case)."""
    return _true(F.lower(source).contains(token)) | _true(F.upper(nationality) == country)


def is_printed(source: Column) -> Column:
    return _true(F.lower(source).contains("printed-"))


def looks_suspicious(value: Column) -> Column:
    low = F.lower(value)
    found = low.contains(SUSPICIOUS[0])
    for part in SUSPICIOUS[1:]:
        found = found | low.contains(part)
    return _true(found)


def issue_count(values: list[Column]) -> Column:
    """How many values look suspicious."""
    return sum((looks_suspicious(v).cast("int") for v in values), F.lit(0))


def plausible_number(c: Column) -> Column:
    return _true(c.rlike(r"\A[A-Z0-9]{7,10}\z"))


def plausible_nationality(c: Column) -> Column:
    return _true(c.rlike(r"\A[A-Z]{3}\z"))


def plausible_sex(c: Column) -> Column:
    return _true(c.isin("M", "F", "X"))


def like_second_line(c: Column) -> Column:
    """28 characters or more, 20 or more without <, in the shape of a second zone line."""
    return _true((F.length(c) >= 28) & (F.length(F.replace(c, F.lit("<"), F.lit(""))) >= 20) & c.rlike(SECOND_LINE))


def useful_name(c: Column) -> Column:
    """Something is left when all but A-Z and blanks are dropped, and it is no label word."""
    left = text.strip(F.regexp_replace(F.upper(c), "[^A-Z ]", ""))
    return _true((left != "") & ~left.isin(*NO_NAMES))
