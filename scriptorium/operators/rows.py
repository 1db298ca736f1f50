"""Helpers over rows: columns that are worked out once, and rows that keep all their columns whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """df and more columns, each worked out once: they come from a generator, so no later filter or projection copies their expressions into itself."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as the struct `row`, and columns under names of their own, so that none of them clashes with the row's."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(name) for name, c in columns.items()))


def unpacked(df: DataFrame, names: list[str], **columns: Column) -> DataFrame:
    """The row's columns again, and more; one of the same name replaces the row's."""
    kept = [F.col("row")[n].alias(n) for n in names if n not in columns]
    return df.select(*kept, *(c.alias(name) for name, c in columns.items()))
