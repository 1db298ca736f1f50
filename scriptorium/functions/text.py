"""Text normalisers as Column expressions. Null stays null unless said otherwise."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.strip and \s remove, as a Java character class.
WS = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same characters, blank first.
WS_ALL = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Sentinels that stand for a missing value (fixed values).
SENTINELS = ("", "___", "__", "_", "N/A", "NULL", "UNKNOWN", "None")


def _accents() -> tuple[str, str]:
    """Letters up to U+1EFF that are a plain one with combining marks, their plain ones, and at the end the marks themselves, which go."""
    whole = [c for c in map(chr, range(0xC0, 0x1F00)) if unicodedata.category(c) != "Mn"]
    pairs = [(c, base) for c in whole for base in ["".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")] if base != c and len(base) == 1]
    marks = "".join(c for c in map(chr, range(0x300, 0x370)) if unicodedata.category(c) == "Mn")
    return "".join(c for c, _ in pairs) + marks, "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()

def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_ALL))


def _one_blank(c: Column) -> Column:
    """Each run of white space as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.translate(c, WS_ALL, " " * len(WS_ALL)), "  +", " "))


def squash(c: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed; empty becomes null."""
    return F.nullif(_one_blank(c), F.lit(""))


def normal_text(c: Column) -> Column:
    """Trimmed, lower case, blanks squashed."""
    return F.lower(_one_blank(c))


def normal_upper(c: Column) -> Column:
    """Upper case, typographic apostrophes plain, blanks squashed."""
    return _one_blank(F.upper(F.translate(c, "’", "'")))


def without_accents(c: Column) -> Column:
    """Letters without their combining marks, in upper case, blanks squashed; apostrophes stay as they are."""
    return _one_blank(F.upper(F.translate(c, ACCENTED, PLAIN)))


def document_number(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def sex(c: Column) -> Column:
    """M or F from a word or a pair like 'X/M'; else its first letter."""
    u = F.upper(squash(c))
    return F.when(u.startswith("M") | u.contains("/M"), "M").when(u.startswith("F") | u.contains("/F"), "F").otherwise(F.left(u, F.lit(1)))


def imported_name(c: Column) -> Column:
    """The last part of 'A / B'; commas as blanks."""
    parts = F.split(squash(c), " / ")
    return squash(F.replace(F.element_at(parts, -1), F.lit(","), F.lit(" ")))


def identity_name(c: Column) -> Column:
    return F.nullif(F.btrim(F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z -]", " "), " +", " "), F.lit(" -")), F.lit(""))


def sanitized(c: Column) -> Column:
    """Trimmed; sentinels, underscores only, and one repeated character over twice become null."""
    t = strip(c)
    same = (F.length(t) > 2) & (F.length(F.replace(t, F.left(t, F.lit(1)), F.lit(""))) == 0)
    return F.when(t.isin(*SENTINELS) | t.rlike("^_+$") | same, None).otherwise(t)


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.replace(c, F.lit("/"), F.lit("__")), "[^A-Za-z0-9_]+", "-"), F.lit("-"))


def tag(c: Column, name: str) -> Column:
    """Text between <name> and the first </name> after it; null if there is none, empty if it is empty."""
    open_, close = f"<{name}>", f"</{name}>"
    rest = F.substr(c, F.locate(open_, c) + F.lit(len(open_)))
    end = F.locate(close, rest)
    return F.when((F.locate(open_, c) > 0) & (end > 0), strip(F.substr(rest, F.lit(1), end - 1)))


def lines(c: Column) -> Column:
    """Lines without white space at their ends; empty ones dropped."""
    return F.filter(F.transform(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip), lambda x: x != "")


def too_sparse(c: Column) -> Column:
    """Under 40 characters, 8 words or 3 lines."""
    return (F.length(strip(c)) < 40) | (F.size(F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]+"), F.lit(0))) < 8) | (F.size(lines(c)) < 3)


def repetitive(values: Column) -> Column:
    """Four values or more of which at most max(2, half) differ."""
    n = F.size(values)
    return (n >= 4) & (F.size(F.array_distinct(values)) <= F.greatest(F.lit(2), F.floor(n / 2)))


def holds(line: Column, markers: tuple[str, ...]) -> Column:
    """Whether a line holds a marker (in upper case); null stays null. One search of one upper-case line for all markers."""
    return F.upper(line).rlike("|".join(rf"\Q{m}\E" for m in markers))


def first_with(ls: Column, markers: tuple[str, ...]) -> Column:
    """Place (from 1) of the first line that holds a marker; null without one."""
    return F.nullif(F.array_position(F.transform(ls, lambda x: holds(x, markers)), F.lit(True)), F.lit(0))


def value_after(ls: Column, markers: tuple[str, ...]) -> Column:
    """The line after the first line that holds a marker (in upper case); null if it is the last one."""
    return F.get(ls, first_with(ls, markers).cast("int"))


def same_or_next(ls: Column, markers: tuple[str, ...]) -> Column:
    """What follows a marker on its line (without ' :-'), else the next line; lines first, then markers."""

    def of(i: Column) -> Column:
        line = F.get(ls, i - 1)
        found = [F.when(F.instr(F.upper(line), F.lit(m)) > 0, F.coalesce(F.nullif(F.btrim(F.substr(line, F.instr(F.upper(line), F.lit(m)) + len(m)), F.lit(" :-")), F.lit("")), F.get(ls, i))) for m in markers]
        return F.coalesce(*found)

    # only lines that hold a marker are cut
    hits = F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: holds(F.get(ls, i - 1), markers))
    return F.when(F.size(ls) > 0, F.get(F.filter(F.transform(hits, of), lambda x: x.isNotNull()), F.lit(0)))


def distinct_lines(ls: Column) -> Column:
    """Lines without repeats (upper case, blanks squashed), first spelling and order kept; empty ones dropped. Sorted and compared within the row, so nothing is shuffled."""
    from scriptorium.functions.mrz import let

    spelled = F.filter(F.transform(ls, squash), lambda x: x.isNotNull())
    # the sort is stable by the place, which comes second
    keyed = F.sort_array(F.transform(spelled, lambda x, i: F.struct(F.upper(x).alias("u"), i.alias("i"), x.alias("x"))))
    first = let(keyed, lambda k: F.filter(k, lambda x, j: (j == 0) | (F.get(k, j - 1)["u"] != x["u"])))
    return F.transform(F.sort_array(F.transform(first, lambda x: F.struct(x["i"], x["x"]))), lambda x: x["x"])
