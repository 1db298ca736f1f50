"""Salvage and flattening of imperfect JSON text, as Column expressions; the trimming of tails is an Arrow-batched UDF."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from scriptorium.functions.mrz import let
from scriptorium.functions.text import strip

#: Keys that a salvage leaves out (fixed values).
IGNORED = ("document_type", "document_content", "text", "text_content", "text_version")


def object_text(c: Column) -> Column:
    """The JSON object in a text: from the first { to the last }, or to the end; trailing commas dropped, missing } added. Null if none parses."""
    clean = lambda x: F.regexp_replace(x, r",\s*([}\]])", "$1")
    missing = lambda x: F.length(F.replace(x, F.lit("}"), F.lit(""))) - F.length(F.replace(x, F.lit("{"), F.lit("")))
    closed = lambda x: F.concat(F.regexp_replace(x, r",\s*\z", ""), F.repeat(F.lit("}"), F.greatest(F.lit(0), missing(x))))
    # the parser stops behind the first value. A text from { on is an object if it ends with } and is the only item of a list,
    # and one of two with another item behind it: a ] that ends the list too early leaves both of one length
    items = lambda x: F.size(F.try_variant_get(F.try_parse_json(x), "$", "array<variant>"))
    good = lambda x: F.rtrim(x, F.lit(" \t\n\r")).endswith("}") & (items(F.concat(F.lit("["), x, F.lit("]"))) == 1) & (items(F.concat(F.lit("["), x, F.lit(",0]"))) == 2)

    # each text is bound, and parsed once; the others are only made if the first one is not good
    def of(tail: Column) -> Column:
        last = F.length(tail) - F.locate("}", F.reverse(tail)) + 1
        return let(F.when(F.locate("}", tail) > 0, F.substr(tail, F.lit(1), last)), lambda cut: F.when(good(cut), cut).otherwise(other(cut, tail)))

    def other(cut: Column, tail: Column) -> Column:
        tries = F.array_distinct(F.array(*(y for x in (cut, tail) for y in (x, clean(x), clean(closed(x))))))
        return F.get(F.filter(tries, lambda x: ~x.eqNullSafe(cut) & good(x)), F.lit(0))

    return let(c, lambda t: F.when(F.locate("{", t) > 0, let(F.substr(t, F.locate("{", t)), of)))


#: Most characters that are trimmed from a tail, less one (fixed value).
TRIMS = 200
_TOKEN = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity|[{}\[\]:,]|[ \t\n\r]+')


def _number_ends(token: str) -> list[int]:
    """Lengths at which a number could end, the whole one included."""
    return [n for n in range(1, len(token) + 1) if re.fullmatch(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?", token[:n])]


def _prefixes(text: str) -> list[int]:
    """Ends of the prefixes of an object's text that are an object once their open braces are closed: one pass of a pushdown automaton."""
    ends: list[int] = []
    stack: list[str] = []
    wanted, at, braces = "value", 0, 0  # what may come next; { less } so far, those in strings too
    while found := _TOKEN.match(text, at):
        token, begin, at = found[0], at, found.end()
        braces += token.count("{") - token.count("}")
        if token[0] in " \t\n\r":
            continue
        if token in "{[" and wanted in ("value", "item"):
            stack.append(token)
            wanted = "key or end" if token == "{" else "item"
        elif token == "}" and stack and stack[-1] == "{" and wanted in ("key or end", "next") or token == "]" and stack and stack[-1] == "[" and wanted in ("item", "next"):
            stack.pop()
            wanted = "next"
        elif token == "," and wanted == "next" and stack:
            wanted = "key" if stack[-1] == "{" else "value"
        elif token == ":" and wanted == "colon":
            wanted = "value"
        elif token[0] == '"' and wanted in ("key", "key or end"):
            wanted = "colon"
        elif token not in "{}[]:," and wanted in ("value", "item"):
            wanted = "next"
            if "[" not in stack and braces == len(stack) and token[0] in "-0123456789" and token[-1] != "y":
                ends += [begin + n for n in _number_ends(token)[:-1]]
        else:
            break
        # whatever is open then must be objects, and as many of them as braces are added (none after a brace that closes)
        if wanted in ("next", "key or end") and "[" not in stack and (not stack if token == "}" else braces == len(stack)):
            ends.append(at)
        if not stack:
            break
    return ends


def _longest(cleaned: str) -> str | None:
    """The object that the least trimming of a text's tail gives."""
    low = len(cleaned) - min(len(cleaned), TRIMS) + 1
    floor = len(cleaned[:low].rstrip(", \n\r\t"))
    for end in sorted((e for e in _prefixes(cleaned) if floor <= e < len(cleaned)), reverse=True):
        # separators alone may stand between this end and the last character that goes
        shortened = cleaned[:end]
        if not shortened.endswith("}"):
            shortened += "}" * (shortened.count("{") - shortened.count("}"))
        try:
            if isinstance(json.loads(shortened), dict):
                return shortened
        except ValueError:
            continue
    return None


def _trimmed(text: str | None) -> str | None:
    if text is None or (start := text.find("{")) < 0:
        return None
    raw = text[start:].strip()
    cut = raw.rfind("}")
    for attempt in ([raw[: cut + 1]] if cut >= 0 else []) + [raw]:
        cleaned = re.sub(r",(\s*[}\]])", r"\1", attempt.strip().strip("`"))
        if found := _longest(cleaned):
            return found
    return None


@pandas_udf(StringType())
def trimmed(texts: pd.Series) -> pd.Series:
    """The JSON object that is left when as little as possible is cut from a text's tail (up to TRIMS - 1 characters) and open braces are closed: first of the text up to its last brace, then of all of it. Null if none parses."""
    return texts.map(_trimmed)


def object_or_trimmed(c: Column) -> Column:
    """object_text, and trimmed where that gives null; only such rows go to Python with a text."""
    found = object_text(c)
    return F.coalesce(found, trimmed(F.when(found.isNull(), c)))


def salvage(c: Column) -> Column:
    """Map of the "key": "value" pairs in a text, values trimmed; blank ones and IGNORED keys are left out, the last of a key wins."""
    pattern = r'"([A-Za-z0-9_]+)"\s*:\s*"([^"]*)"'
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("v"))
    kept = F.filter(F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), strip(p["v"]).alias("v"))), lambda p: (p["v"] != "") & ~p["k"].isin(*IGNORED))
    keys = F.array_distinct(F.transform(kept, lambda p: p["k"]))
    last = lambda k: F.element_at(F.filter(kept, lambda p: p["k"] == k), -1)["v"]
    return F.when(c.isNotNull(), F.map_from_arrays(keys, F.transform(keys, last)))


def flat(fields: dict[str, Column]) -> Column:
    """Map of the fields that are not null, as strings: paths are the keys; booleans are True and False."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in fields.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
