"""Dates and amounts as Column expressions; century rules are named and never mixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mrz_iso(c: Column, this_year: int, expiry: bool = False) -> Column:
    """YYMMDD to ISO: an expiry is in 20xx, a birth in 19xx if its year is over this_year % 100; impossible dates are null."""
    d = F.replace(c, F.lit("<"), F.lit(""))
    yy = F.left(d, F.lit(2))
    century = F.lit("20") if expiry else F.when(yy.try_cast("int") > this_year % 100, "19").otherwise("20")
    return F.when(d.rlike(r"^[0-9]{6}\z"), F.date_format(F.try_to_date(F.concat(century, d), "yyyyMMdd"), "yyyy-MM-dd"))


def mrz_dotted(c: Column, pivot: int) -> Column:
    """YYMMDD to DD.MM.YYYY; years from the pivot on are in 19xx. No calendar check."""
    yy = F.left(c, F.lit(2))
    return F.when(c.rlike(r"^[0-9]{6}\z"), F.concat(F.substring(c, 5, 2), F.lit("."), F.substring(c, 3, 2), F.lit("."), F.when(yy.try_cast("int") >= pivot, "19").otherwise("20"), yy))


def compact_slashes(c: Column) -> Column:
    """DDMMYY or DDMMYYYY to DD/MM/YYYY (20xx)."""
    d = F.regexp_replace(c, "[^0-9]", "")
    year = F.when(F.length(d) == 6, F.concat(F.lit("20"), F.substring(d, 5, 2))).when(F.length(d) == 8, F.substring(d, 5, 4))
    return F.when(year.isNotNull(), F.concat_ws("/", F.substring(d, 1, 2), F.substring(d, 3, 2), year))


def space_date(c: Column) -> Column:
    """The first three groups of 2 to 4 digits, joined by '/'; a year of two digits is in 20xx."""
    g = F.regexp_extract_all(c, F.lit("[0-9]{2,4}"), F.lit(0))
    year = F.get(g, F.lit(2))
    return F.when(F.size(g) >= 3, F.concat_ws("/", F.get(g, F.lit(0)), F.get(g, F.lit(1)), F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)))


def mmddyyyy(c: Column) -> Column:
    """Whether the digits are a plausible MMDDYYYY (no calendar check)."""
    return F.coalesce(F.regexp_replace(c, "[^0-9]", "").rlike(r"\A(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])(?:19|20)[0-9]{2}\z"), F.lit(False))


def ordinal(c: Column) -> Column:
    """MM/DD/YYYY as a number yyyymmdd, null if out of range."""
    d = F.trim(c)
    ok = d.rlike(r"\A(?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])/(?:19|20)[0-9]{2}\z")
    return F.when(ok, F.concat(F.substring(d, 7, 4), F.substring(d, 1, 2), F.substring(d, 4, 2)).cast("int"))


def amount(c: Column) -> Column:
    """'$ 1.234,56' as a number: dots group, a comma is the decimal sign; null if it is no number."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"[$ .]", "")
    return F.replace(t, F.lit(","), F.lit(".")).try_cast("double")


def amount_text(c: Column) -> Column:
    """The first amount in German spelling, as '$ x'."""
    found = F.regexp_extract(c, r"([0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2}|[0-9]+,[0-9]{2})", 1)
    return F.when(found != "", F.concat(F.lit("$ "), found))


def amount_similarity(p: Column, g: Column) -> Column:
    """max(0, 1 - |p - g| / |g|); for g = 0 whether p = 0; 0 if one is null."""
    score = F.when(g == 0, F.when(p == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(F.abs(p - g), F.abs(g))))
    return F.when(p.isNull() | g.isNull(), 0.0).otherwise(score)


#: Month names of dates like 5 MAR 2020 (fixed values).
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def dotted(c: Column) -> Column:
    """Normal form for scoring: D MON YYYY and D.M.YYYY (also with / or -) become DD.MM.YYYY; other text is only put in upper case and squashed."""
    from scriptorium.functions.text import normal_upper

    t = F.translate(normal_upper(c), "/-", "..")
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    named, plain = r"^([0-9]{1,2}) ([A-Z]{3}) ([0-9]{4})\z", r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})\z"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(named, 2))
    two = lambda x: F.lpad(x, 2, "0")
    return F.when(month > 0, F.concat_ws(".", two(part(named, 1)), two(month.cast("string")), part(named, 3))).when(t.rlike(plain), F.concat_ws(".", two(part(plain, 1)), two(part(plain, 2)), part(plain, 3))).otherwise(t)


def _apart(pattern: str) -> str:
    return r"(?<![\p{L}\p{N}_])" + pattern + r"(?![\p{L}\p{N}_])"


def _from_tokens(mmdd: Column, ls: Column, plausible: bool) -> Column:
    """MM/DD/YYYY from the first token of eight digits in the lines that starts with mmdd."""
    tokens = F.flatten(F.transform(ls, lambda x: F.regexp_extract_all(x, F.lit(_apart("[0-9]{8}")), F.lit(0))))
    year = lambda t: F.substring(t, 5, 4).cast("int")
    hit = F.get(F.filter(tokens, lambda t: t.startswith(mmdd) & (year(t).between(1900, 2099) if plausible else F.lit(True))), F.lit(0))
    return F.when(hit.isNotNull(), F.concat_ws("/", F.left(mmdd, F.lit(2)), F.substring(mmdd, 3, 2), F.substring(hit, 5, 4)))


def repaired_year(c: Column, ls: Column) -> Column:
    """MM/DD/YYYY with a year in 1900 to 2099: its own, one of a token with the same month and day, or by century (16xx to 18xx are 19xx, 21xx to 29xx are 20xx); else null."""
    part = lambda i: F.regexp_extract(c, r"^([0-9]{2})/([0-9]{2})/([0-9]{4})\z", i)
    year = part(3).try_cast("int")
    with_century = lambda x: F.concat(F.left(c, F.lit(6)), F.lit(x), F.right(part(3), F.lit(2)))
    guess = F.when(year.between(1600, 1899), with_century("19")).when(year.between(2100, 2999), with_century("20"))
    return F.when(year.between(1900, 2099), c).when(year.isNotNull(), F.coalesce(_from_tokens(F.concat(part(1), part(2)), ls, True), guess))


def identity_date(c: Column, ls: Column) -> Column:
    """MM/DD/YYYY from a date of a licence or card: years of too many, three or two digits are mended, eight digits are split; else the text if it holds a digit."""
    from scriptorium.functions.mrz import let

    # worked out once, and only digits make a date
    return let(c, lambda v: F.when(v.rlike("[0-9]"), _dated(v, ls)))


def _dated(c: Column, ls: Column) -> Column:
    part = lambda pattern, i: F.regexp_extract(c, _apart(pattern), i)
    direct, long_, over = "[0-9]{2}/[0-9]{2}/[0-9]{4}", "([0-9]{2})/([0-9]{2})/1([0-9]{4})", "([0-9]{2})/([0-9]{2})/[0-9]{2}([0-9]{4})"
    three, two, compact = "([0-9]{2})/([0-9]{2})/([0-9]{3})", "([0-9]{2})/([0-9]{2})/([0-9]{2})", "([0-9]{2})([0-9]{2})([0-9]{4})"
    has = lambda pattern: c.rlike(_apart(pattern))
    dated = lambda pattern, year: F.concat_ws("/", part(pattern, 1), part(pattern, 2), year)
    token = lambda pattern: _from_tokens(F.concat(part(pattern, 1), part(pattern, 2)), ls, False)
    century = F.when(part(two, 3).try_cast("int") >= 30, "19").otherwise("20")
    whole = part(direct, 0)
    return (
        F.when(has(direct), F.coalesce(repaired_year(whole, ls), whole))
        .when(has(long_), dated(long_, part(long_, 3)))
        .when(has(over), dated(over, part(over, 3)))
        .when(has(three), F.coalesce(token(three), dated(three, F.concat(F.lit("1"), part(three, 3)))))
        .when(has(two), F.coalesce(token(two), dated(two, F.concat(century, part(two, 3)))))
        .when(mmddyyyy(part(compact, 0)), dated(compact, part(compact, 3)))
        .when(c.rlike("[0-9]"), F.trim(c))
    )


def better_identity_date(candidate: Column, current: Column, birth: bool) -> Column:
    """Whether a candidate should replace the current date: births tend to earlier years but from 1930 on over older ones given last, expiries to later ones."""
    return better_ordinal(ordinal(candidate), ordinal(current), birth)


def better_ordinal(new: Column, old: Column, birth: bool) -> Column:
    """better_identity_date of two ordinals, which are best worked out in a stage before: it names them often."""
    y, was = F.floor(new / 10000), F.floor(old / 10000)
    last = 2030 if birth else 2035
    out = F.when(new.isNull(), False).when(old.isNull(), True).when(was > last, True).when(y > last, False)
    if birth:
        out = out.when((was < 1930) & (y >= 1930), False).when((y < 1930) & (was >= 1930), True).otherwise(y <= was)
    else:
        out = out.otherwise(y >= was)
    return out


def better_issue_date(candidate: Column, current: Column, birth: Column, expiry: Column) -> Column:
    """Whether a candidate should replace the issue date: it must lie between birth and expiry; the earlier of two such dates is better."""
    new, old, low, high = ordinal(candidate), ordinal(current), ordinal(birth), ordinal(expiry)
    outside = lambda x: F.coalesce(x <= low, F.lit(False)) | F.coalesce(x >= high, F.lit(False))
    return F.when(new.isNull() | outside(new), False).when(old.isNull() | outside(old), True).otherwise(new <= old)


def _first(ls: Column, pattern: str, excluded: Column, group: int = 1) -> Column:
    """The first date of a pattern, line by line, that is not excluded."""
    said = F.filter(F.transform(ls, lambda x: F.regexp_extract(F.upper(x), pattern, group)), lambda d: d != "")
    found = F.transform(said, lambda d: identity_date(d, ls))
    return F.get(F.filter(found, lambda d: d.isNotNull() & ~F.array_contains(excluded, d)), F.lit(0))


def _labelled(label: str) -> str:
    return _apart(label) + "[^0-9]*([0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{8})"


def issue_date(ls: Column, birth: Column, expiry: Column) -> Column:
    """The issue date in a licence's lines: after ISS, after DD, else the last date of the first line that holds one besides birth and expiry."""
    known = F.array(F.coalesce(birth, F.lit("")), F.coalesce(expiry, F.lit("")))
    bare = F.flatten(F.transform(ls, lambda x: F.reverse(F.regexp_extract_all(x, F.lit(_apart("[0-9]{2}/[0-9]{2}/[0-9]{4}")), F.lit(0)))))
    return F.coalesce(_first(ls, _labelled("ISS"), known), _first(ls, _labelled("DD"), known), F.get(F.filter(bare, lambda d: ~F.array_contains(known, d)), F.lit(0)))


def birth_date(ls: Column, issue: Column, expiry: Column) -> Column:
    """The birth date in a licence's lines: after DOB, else the first plausible token of eight digits besides issue and expiry."""
    known = F.array(F.coalesce(issue, F.lit("")), F.coalesce(expiry, F.lit("")))
    tokens = F.flatten(F.transform(ls, lambda x: F.regexp_extract_all(x, F.lit(_apart("[0-9]{8}")), F.lit(0))))
    dated = F.transform(F.filter(tokens, mmddyyyy), lambda t: F.concat_ws("/", F.left(t, F.lit(2)), F.substring(t, 3, 2), F.substring(t, 5, 4)))
    return F.coalesce(_first(ls, _labelled("DOB"), known), F.get(F.filter(dated, lambda d: ~F.array_contains(known, d)), F.lit(0)))
