"""Recognition engines by name: rows carry the engine that they want, and one pass over the table serves them all."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.rows import packed

#: Engines of record types that ask for none, and that of all others (fixed values).
DEFAULTS = {"invoice": "donut"}
OTHERWISE = "paddleocr_vl"

Engine = Callable[[bytes], str]


def wanted(requested: Column, kind: Column) -> Column:
    """The requested engine, else the default of the record's type."""
    out = F.lit(OTHERWISE)
    for k, name in DEFAULTS.items():
        out = F.when(kind == k, name).otherwise(out)
    return F.coalesce(F.nullif(requested, F.lit("")), out)


def dispatched(df: DataFrame, registry: dict[str, Callable[[], Engine]], engine: str = "engine", key: str = "id", content: str = "content") -> DataFrame:
    """key, engine, text, error, elapsed_ms: each row by the engine that it names.

    registry has a factory for each name; a worker calls it once, when it meets the first row of that engine, so that models that a
    task's rows don't want aren't loaded. An unknown name, a factory that fails and an engine that raises are errors of their rows
    alone. Rows stay in their partitions; nothing is shuffled, whatever the shares of the engines.
    """

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, Engine | Exception] = {}

        def load(name: str) -> Engine:
            if name not in loaded:
                try:
                    if name not in registry:
                        raise ValueError(f"Unsupported extraction engine: {name}")
                    loaded[name] = registry[name]()
                except Exception as e:  # noqa: BLE001  whatever a factory raises is the error of its rows
                    loaded[name] = e
            found = loaded[name]
            if isinstance(found, Exception):
                raise found
            return found

        for frame in frames:
            rows = []
            for k, name, raw in zip(frame["k"], frame["e"], frame["c"], strict=True):
                began = time.monotonic()
                try:
                    said, error = load(name)(raw), None
                except Exception as e:  # noqa: BLE001  whatever an engine raises is that row's error
                    said, error = None, str(e) or type(e).__name__
                rows.append((k, name, said, error, int((time.monotonic() - began) * 1000)))
            yield pd.DataFrame(rows, columns=["k", "e", "text", "error", "elapsed_ms"])

    kind = df.schema[key].dataType.simpleString()
    source = packed(df, k=F.col(key), e=F.col(engine).cast("string"), c=F.col(content)).select("k", "e", "c")
    out = source.mapInPandas(step, f"k {kind}, e string, text string, error string, elapsed_ms long")
    return out.select(F.col("k").alias(key), F.col("e").alias("engine"), "text", "error", "elapsed_ms")
