"""A compiler of ranked rules: for each field an ordered list of sources, of which the first that has a value gives it.

Rules are data. compiled() turns a table of them into one struct expression, so that a whole record is chosen in one projection,
whatever the number of sources, and each value comes with the name of the source that gave it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.mrz import let


@dataclass(frozen=True)
class Rule:
    """A value that a field may take from a source. `when` is a gate (null is no). A rule that is `last` ends the search at its gate, even without a value."""

    field: str
    source: str
    value: Column
    when: Column | None = None
    last: bool = False


def compiled(rules: list[Rule]) -> Column:
    """Struct of the fields in the order of their first rule, each (value, source); rules of a field are tried in their order. Blank values are none."""

    def of(field: str) -> Column:
        own = [r for r in rules if r.field == field]
        gate = lambda r: F.lit(True) if r.when is None else F.coalesce(r.when, F.lit(False))
        tried = F.array(*(F.struct(r.value.cast("string").alias("value"), F.lit(r.source).alias("source"), gate(r).alias("open"), F.lit(r.last).alias("last")) for r in own))
        first = F.get(F.filter(tried, lambda x: x["open"] & (x["last"] | (F.coalesce(F.trim(x["value"]), F.lit("")) != ""))), F.lit(0))
        return let(first, lambda found: F.struct(found["value"].alias("value"), F.when(found["value"].isNotNull(), found["source"]).alias("source")))

    return F.struct(*(of(f).alias(f) for f in dict.fromkeys(r.field for r in rules)))


def record(chosen: str, fields: list[str], changed: dict[str, Column] | None = None) -> Column:
    """(fields, sources) of a compiled column; `changed` has values that were worked on afterwards. A field without a value has no source."""
    value = {f: (changed or {}).get(f, F.col(f"{chosen}.{f}.value")) for f in fields}
    source = {f: F.when(value[f].isNotNull(), F.col(f"{chosen}.{f}.source")) for f in fields}
    return F.struct(F.struct(*(value[f].alias(f) for f in fields)).alias("fields"), F.struct(*(source[f].alias(f) for f in fields)).alias("sources"))


def verdict(populated: Column, good: str, poor: str, least: int = 4) -> Column:
    """(is_valid, code, severity) by the number of filled fields."""
    ok = populated >= least
    return F.struct(ok.alias("is_valid"), F.when(ok, good).otherwise(poor).alias("code"), F.when(ok, "info").otherwise("warning").alias("severity"))
