"""Open-schema JSON, tagged sequences and string ratios: what Column expressions cannot express, as Arrow-batched UDFs.

Null or unreadable text gives null; every function works on one row at a time and keeps nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, MapType, StringType

TAG = re.compile(r"<(/?)s_([^>]+)>")


def _loaded(text: object) -> object:
    try:
        return json.loads(text) if isinstance(text, str) else None
    except ValueError:
        return None


def _leaves(path: str, node: object, joined: bool) -> Iterator[tuple[str, object]]:
    """Paths and scalars, depth first. With joined, a list of scalars only is one leaf, its items joined by commas."""
    if isinstance(node, dict):
        for k, v in node.items():
            yield from _leaves(f"{path}.{k}" if path else k, v, joined)
    elif not isinstance(node, list):
        yield path, node
    elif joined and node and not any(isinstance(x, (dict, list)) for x in node):
        yield path, ",".join(map(str, node))
    else:
        for i, v in enumerate(node):
            yield from _leaves(f"{path}[{i}]", v, joined)


@pandas_udf(MapType(StringType(), StringType()))
def flatten(texts: pd.Series) -> pd.Series:
    """Map of path to value: nulls are left out, lists of scalars are joined by commas, other lists are indexed; booleans are True and False."""
    nodes = texts.map(_loaded)
    return nodes.map(lambda n: None if n is None else {p: str(v) for p, v in _leaves("", n, True) if v is not None})


@pandas_udf(ArrayType(StringType()))
def flat_pairs(texts: pd.Series) -> pd.Series:
    """path=value strings by sorted keys: all lists are indexed, null is None."""
    return texts.map(lambda t: None if _loaded(t) is None else [f"{p}={v}" for p, v in _leaves("", json.loads(json.dumps(_loaded(t), sort_keys=True)), False)])


@pandas_udf(LongType())
def populated_leaves(texts: pd.Series) -> pd.Series:
    """Leaves of JSON that are neither null nor blank, however deep; 0 for null and unreadable text."""
    return texts.map(lambda t: sum(v is not None and str(v).strip() != "" for _, v in _leaves("", _loaded(t), False)))


@pandas_udf(StringType())
def canonical(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys and no blanks."""
    return texts.map(lambda t: None if _loaded(t) is None else json.dumps(_loaded(t), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


class _Node:
    """An open tag: its text, its children in the order of their first appearance, and whether the text came before them."""

    def __init__(self):
        self.text, self.children, self.text_first = "", {}, False

    def say(self, text: str) -> None:
        if text:
            self.text_first |= not self.text and not self.children
            self.text += text

    def plain(self) -> object:
        if self.text_first:
            return self.text
        out = {"items" if name == "item" else name: [n.plain() for n in nodes] if name == "item" or len(nodes) > 1 else nodes[0].plain() for name, nodes in self.children.items()}
        return out | ({"value": self.text} if self.text else {})


def _tree(text: str) -> object:
    root = _Node()
    path, at = [root], 0
    for found in [*TAG.finditer(text), None]:
        path[-1].say(text[at : found.start() if found else len(text)].strip())
        if found is None:
            break
        at = found.end()
        if not found[1]:
            child = _Node()
            path[-1].children.setdefault(found[2], []).append(child)
            path.append(child)
        elif len(path) > 1:
            path.pop()
    return root.plain()


@pandas_udf(StringType())
def parse_tags(texts: pd.Series) -> pd.Series:
    """Tagged sequence to canonical JSON: repeated tags and items become lists, a stray close is ignored, tags left open are closed at the end. Null if empty.

    Text after child tags becomes `value`; text before them stands for the whole tag.
    """
    return texts.map(lambda t: json.dumps(_tree(t), ensure_ascii=False, sort_keys=True, separators=(",", ":")) if isinstance(t, str) and _tree(t) else None)


@pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings; 0 if one is null or empty."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def json_scores(truth: Column, tagged: Column) -> Column:
    """(exact, field_f1, similarity) of a tagged answer against JSON: equal canonical texts, F1 of the sets of path=value (1 if both are empty), and the ratio of the canonical texts.

    An answer without tags or a truth that isn't JSON scores 0 but for the similarity, which then compares the texts as they are.
    """
    want, got = canonical(truth), parse_tags(tagged)
    a, b = F.array_distinct(flat_pairs(truth)), F.array_distinct(flat_pairs(got))
    both = F.size(a) + F.size(b)
    score = F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)
    x, y = F.coalesce(want, truth, F.lit("")), F.coalesce(got, F.btrim(tagged), F.lit(""))
    near = F.when((x == "") & (y == ""), 1.0).otherwise(ratio(x, y))
    return F.struct(F.coalesce(want == got, F.lit(False)).alias("exact"), F.coalesce(F.when(want.isNotNull() & got.isNotNull(), score), F.lit(0.0)).alias("field_f1"), near.alias("similarity"))


def digit_similarity(a: Column, b: Column) -> Column:
    """Ratio of the digits of two strings."""
    only = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    return ratio(only(a), only(b))


def date_similarity(a: Column, b: Column) -> Column:
    """Share of the first three number groups that agree; the ratio of the groups where one has fewer; 0 without groups."""
    groups = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]{1,4}"), F.lit(0))
    x, y = groups(a), groups(b)
    same = sum((F.get(x, F.lit(i)) == F.get(y, F.lit(i))).cast("int") for i in range(3))
    return F.when((F.size(x) >= 3) & (F.size(y) >= 3), same / F.lit(3.0)).otherwise(ratio(F.array_join(x, "/"), F.array_join(y, "/")))
