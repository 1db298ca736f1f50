"""Readers and writers of JSON lines, and rows by a listing of files; CSV and JSON metadata are in metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str, fail: bool = True) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped; a bad line fails the read, or is dropped."""
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = text.select(F.from_json("value", schema, {"mode": "FAILFAST" if fail else "PERMISSIVE"}).alias("r"), "value")
    return parsed.select("r.*") if fail else parsed.where(F.try_parse_json("value").isNotNull()).select("r.*")


def read_jsonl_files(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Several files in order, each row with file_no; rows of one file keep their offset order in line_no, which has gaps."""
    parts = [spark.read.text(p).select(F.lit(i).alias("file_no"), F.monotonically_increasing_id().alias("line_no"), "value") for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.trim("value") != "").select("file_no", "line_no", F.from_json("value", schema).alias("r")).select("file_no", "line_no", "r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line; nulls are kept, as they are significant keys."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def existing(df: DataFrame, listing: DataFrame, path: str = "image_path") -> DataFrame:
    """Rows whose file is in a listing (a column `path`, such as that of binaryFile)."""
    return df.join(listing.select(F.col("path").alias(path)).distinct(), path, "left_semi")
