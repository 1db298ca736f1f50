"""Reuse of results: a memo table keyed by what was computed on, so that a second run computes only what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptorium.sources.shared import exists


def content_key(*columns: Column | str) -> Column:
    """A 256-bit hash of the columns' JSON: equal content has an equal key, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


class Memo:
    """Results by key in a folder of Parquet files, to which runs append. Of several results of a key the one of the last run counts."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path = spark, path
        self.schema = spark.createDataFrame([], schema).schema  # of the results alone

    def read(self) -> DataFrame:
        """memo_key, run and the result's columns, one row for each key."""
        full = StructType.fromDDL("memo_key string, run long")
        for f in self.schema:
            full = full.add(f)
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], full)
        raw = self.spark.read.schema(full).parquet(self.path)
        last = raw.groupBy("memo_key").agg(F.max_by(F.struct(*raw.columns), "run").alias("r"))
        return last.select("r.*")

    def apply(self, df: DataFrame, compute: Callable[[DataFrame], DataFrame], key: Column, run: int) -> tuple[DataFrame, int]:
        """df with its results (struct `result`), and how many distinct keys had to be computed.

        compute gets a row of df for each key that the memo lacks, with its memo_key, and returns memo_key and the result's
        columns. What it gives is appended to the memo before anything is read from there, so that a run that fails later has
        not computed in vain, and a lost executor doesn't compute anew.
        """
        keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), key.alias("memo_key"))
        new = keyed.join(self.read().select("memo_key"), "memo_key", "left_anti").groupBy("memo_key").agg(F.any_value("row").alias("row"))
        fresh = compute(new.select("row.*", "memo_key")).select("memo_key", F.lit(run).cast("long").alias("run"), *(F.col(f.name).cast(f.dataType) for f in self.schema))
        before = self.read().count()
        fresh.write.mode("append").parquet(self.path)
        memo = self.read()
        result = F.struct(*(F.col(f.name) for f in self.schema)).alias("result")
        out = keyed.join(memo.select("memo_key", result), "memo_key", "left")
        return out.select(*(F.col("row")[c].alias(c) for c in df.columns), "result"), memo.count() - before
