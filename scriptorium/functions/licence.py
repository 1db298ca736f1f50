"""Driver licences and flat answers from recognised lines, as Column expressions on array<string> of lines (text.lines gives them). Null lines give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.dates import mmddyyyy
from scriptorium.functions.mrz import let
from scriptorium.functions.payload import CATEGORIES, EDGE_L, EDGE_R, license_categories
from scriptorium.functions.text import holds, strip

#: Labels of lines and words that are no values (fixed values).
CATEGORY_MARKERS = ("CATEGORY", "CATEGORIES", "CAT.", "CLASS")
NUMBER_NEIGHBOURS = ("DL", "EXP", "CLASS")
NO_NUMBERS = ("CALIFORNIA", "ALIFORNIA", "DRIVER", "LICENSE", "CLASS", "NONE")
NO_ADDRESS = ("DOB", "EXP", "SEX", "HAIR", "EYES", "WGT", "RGT", "ISS", "DD")
#: Labels beside a number, and words that a number is not (fixed values).
NUMBER_MARKERS = ("LIC", "LIC#", "LICENSE", "DL", "DL#", "DI")
NO_NUMBER_TEXT = ("CALIFORNIA", "ALIFORNIA", "DRIVERLICENSE")
NO_SURNAME = ("UNITED STATES", "PASSPORT", "GIVEN NAMES", "NATIONALITY", "DATE OF", "SIGNATURE", "TYPE /", "PLACE", "SEE PAGE")


def _any(line: Column, markers: tuple[str, ...]) -> Column:
    return F.coalesce(holds(line, markers), F.lit(False))


def _positions(ls: Column) -> Column:
    return F.when(F.size(ls) > 0, F.sequence(F.lit(0), F.size(ls) - 1)).otherwise(F.array().cast("array<int>"))


def categories(ls: Column) -> Column:
    """Categories on lines with a category marker, in order without repeats: those named right after a marker, else those of the text after the first marker in the markers' order."""

    def of(line: Column) -> Column:
        u = F.upper(line)
        named = [F.nullif(F.regexp_extract(u, f"{EDGE_L}(?:{label})\\s+({CATEGORIES}){EDGE_R}", 1), F.lit("")) for label in ("CLASS", "CATEGORY|CATEGORIES|CAT\\.")]
        explicit = F.array_compact(F.array(*named))
        tail = u
        for m in reversed(CATEGORY_MARKERS):
            tail = F.when(F.contains(u, F.lit(m)), F.substr(u, F.instr(u, m) + len(m))).otherwise(tail)
        return F.when(F.size(explicit) > 0, explicit).otherwise(license_categories(tail))

    return F.array_distinct(F.flatten(F.transform(F.filter(ls, lambda x: _any(x, CATEGORY_MARKERS)), of)))


def fallback_number(ls: Column, excluded: Column) -> Column:
    """The licence number without a label: a line of 6 to 12 digits beside a DL, EXP or CLASS line, else the best such line (no date, longest, smallest), else the first token of 6 to 12 characters.

    excluded is an array of digit strings, such as those of known dates. An empty array excludes nothing.
    """

    def of(x: Column) -> Column:
        at = lambda i: F.get(x, i)
        numeric = F.filter(_positions(x), lambda i: strip(at(i)).rlike(r"^[0-9]{6,12}\z") & ~F.array_contains(excluded, strip(at(i))))
        beside = F.filter(numeric, lambda i: (_any(F.when(i > 0, at(i - 1)), NUMBER_NEIGHBOURS) | _any(at(i + 1), NUMBER_NEIGHBOURS)) & ~mmddyyyy(strip(at(i))))
        best = F.array_min(F.transform(numeric, lambda i: F.struct(mmddyyyy(strip(at(i))).alias("dated"), (-F.length(strip(at(i)))).alias("n"), strip(at(i)).alias("v"))))
        tokens = F.flatten(F.transform(x, lambda line: F.regexp_extract_all(line, F.lit(f"{EDGE_L}[A-Z0-9]{{6,12}}{EDGE_R}"), F.lit(0))))
        token = F.get(F.filter(tokens, lambda t: ~t.isin(*NO_NUMBERS) & ~F.array_contains(excluded, t) & ~mmddyyyy(t)), F.lit(0))
        return F.coalesce(strip(at(F.get(beside, F.lit(0)))), best["v"], token)

    return let(ls, of)


def labelled_number(ls: Column, excluded: Column) -> Column:
    """The licence number by a label: of the lines that hold one, in order, the first token of 6 to 12 characters that is no word, known date or date, else one of the two lines below of 6 to 12 digits."""

    def of(x: Column) -> Column:
        good = lambda t: ~F.upper(t).isin(*NO_NUMBERS) & ~F.array_contains(excluded, t) & ~mmddyyyy(t)
        tokens = lambda i: F.filter(F.regexp_extract_all(F.get(x, i), F.lit(f"{EDGE_L}[A-Z0-9]{{6,12}}{EDGE_R}"), F.lit(0)), good)
        below = lambda i: F.filter(F.transform(F.slice(x, i + 2, F.lit(2)), strip), lambda t: t.rlike(r"^[0-9]{6,12}\z") & ~F.array_contains(excluded, t) & ~mmddyyyy(t))
        marked = F.filter(_positions(x), lambda i: _any(F.get(x, i), NUMBER_MARKERS))
        found = F.transform(marked, lambda i: F.coalesce(F.get(tokens(i), F.lit(0)), F.get(below(i), F.lit(0))))
        return F.get(F.array_compact(found), F.lit(0))

    return let(ls, of)


def number(ls: Column, excluded: Column) -> Column:
    """The licence number: by a label, else without one. excluded has the digits of known dates."""
    return F.coalesce(labelled_number(ls, excluded), fallback_number(ls, excluded))


def normal_number(c: Column, ls: Column, excluded: Column) -> Column:
    """A licence number in letters and digits; one that is a label, has no digit or is a date is sought anew: a line of digits beside a label, then what follows DL. Null without a number."""

    def again(x: Column) -> Column:
        at = lambda i: F.get(x, i)
        free = lambda t: ~F.array_contains(excluded, t) & ~mmddyyyy(t)
        beside = F.filter(_positions(x), lambda i: strip(at(i)).rlike(r"^[0-9]{6,12}\z") & free(strip(at(i))) & (_any(F.when(i > 0, at(i - 1)), NUMBER_NEIGHBOURS) | _any(at(i + 1), NUMBER_NEIGHBOURS)))
        after = F.filter(F.transform(x, lambda line: F.regexp_extract(F.upper(line), f"{EDGE_L}DL{EDGE_R}[^0-9A-Z]*([A-Z0-9]{{6,12}})", 1)), lambda t: (t != "") & ~t.isin(*NO_NUMBER_TEXT[:2]) & free(t))
        return F.coalesce(strip(at(F.get(beside, F.lit(0)))), F.get(after, F.lit(0)))

    def kept(t: Column) -> Column:
        dated = t.rlike(r"^[0-9]+\z") & (F.array_contains(excluded, t) | mmddyyyy(t))
        return F.when(~t.isin(*NO_NUMBER_TEXT) & t.rlike("[0-9]") & ~dated, t)

    compact = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return F.when(F.coalesce(c, F.lit("")) != "", F.coalesce(let(compact, kept), let(ls, again)))


def address(ls: Column) -> Column:
    """The first line with a digit and no label among the four after a line with FN; later such lines if there is none."""

    def of(x: Column) -> Column:
        starts = F.filter(_positions(x), lambda i: F.upper(F.get(x, i)).contains("FN ") | F.upper(F.get(x, i)).startswith("FN"))
        after = F.flatten(F.transform(starts, lambda i: F.slice(x, i + 2, F.lit(4))))
        return F.get(F.filter(F.transform(after, strip), lambda c: c.rlike("[0-9]") & ~_any(c, NO_ADDRESS)), F.lit(0))

    return let(ls, of)


def surname_before(ls: Column) -> Column:
    """The nearest line before GIVEN NAMES that has no digit, no label and more than one character; later such markers if there is none."""

    def of(x: Column) -> Column:
        markers = F.filter(_positions(x), lambda i: F.upper(F.get(x, i)).contains("GIVEN NAMES"))
        before = F.flatten(F.transform(markers, lambda i: F.reverse(F.slice(x, F.lit(1), i))))
        return F.get(F.filter(F.transform(before, strip), lambda c: (F.length(c) > 1) & ~c.rlike("[0-9]") & ~_any(c, NO_SURNAME)), F.lit(0))

    return let(ls, of)


def flat_answer(ls: Column, allowed: tuple[str, ...]) -> Column:
    """Map of the `key: value` lines with an allowed key (in any case); empty values and null are left out, the last of a key wins."""
    key, value = r"^[A-Za-z_]+\s*:", r"^[A-Za-z_]+\s*:\s*(.*)\z"
    parts = F.transform(F.filter(ls, lambda x: x.rlike(key)), lambda x: F.struct(F.lower(F.regexp_extract(x, "^[A-Za-z_]+", 0)).alias("k"), strip(F.regexp_extract(x, value, 1)).alias("v")))
    kept = F.filter(parts, lambda p: p["k"].isin(*allowed) & ~F.lower(p["v"]).isin("", "null"))

    def last(ps: Column) -> Column:
        keys = F.array_distinct(F.transform(ps, lambda p: p["k"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(ps, lambda p: p["k"] == k), -1)["v"]))

    return let(kept, last)
