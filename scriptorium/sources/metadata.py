"""Metadata files of other data sets: CSV in several encodings and with several separators, JSON lists and grouped JSON, in one scan; scans that count what they reject."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Encodings in the order in which they are tried (fixed values).
ENCODINGS = ("utf-8-sig", "cp1251", "utf-8")
#: Groups of a grouped JSON file, and the column that takes their names (fixed values).
GROUPS, GROUP_COLUMN = ("male", "female"), "gender"


def decoded(raw: bytes) -> str:
    """Text in the first encoding that fits."""
    for encoding in ENCODINGS[:-1]:
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode(ENCODINGS[-1])


def _csv_rows(text: str) -> list[dict]:
    """Rows of a CSV text with a header, by ; if the first line has one, else by commas; those without any value are left out."""
    lines = text.splitlines()
    rows = csv.DictReader(lines, delimiter=";" if lines and ";" in lines[0] else ",")
    return [{k: v for k, v in r.items() if k is not None} for r in rows if any(str(v).strip() for v in r.values() if v is not None)]


def _json_rows(text: str) -> list[dict]:
    found = json.loads(text)
    if isinstance(found, dict):
        return [dict(r) | {GROUP_COLUMN: g} for g in GROUPS for r in found.get(g) or []]
    return found if isinstance(found, list) else []


def read_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, row_no (from 0), fields (map of texts), error of all rows of the files: *.json as lists or groups, others as CSV.

    A file is one task's work, as its encoding and quoting can only be told from its start; such files describe a data set and
    are small. A file that can't be read gives one row with its error, and spoils no other.
    """

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = _json_rows(bytes(raw).decode("utf-8")) if path.lower().endswith(".json") else _csv_rows(decoded(bytes(raw)))
                    out = [(path, i, {k: None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in r.items()}, None) for i, r in enumerate(rows)]
                except (ValueError, AttributeError, TypeError) as e:
                    out = [(path, None, None, str(e) or type(e).__name__)]
                yield pd.DataFrame(out, columns=["path", "row_no", "fields", "error"]).astype({"row_no": "Int64"})

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(step, "path string, row_no long, fields map<string, string>, error string")


def discovered(listing: DataFrame, root: str, path: str = "path") -> DataFrame:
    """The metadata file of each data set: the first path, sorted, under its folder metadata/. listing has the paths and the data set's name in the column `root`."""
    under = listing.where(F.col(path).rlike("(^|/)metadata/"))
    return under.groupBy(root).agg(F.min(path).alias("metadata_path"))


def blobs(spark: SparkSession, root: str, keys: DataFrame, key: str = "key") -> DataFrame:
    """key and content (null where there is none) of the files under root that keys name."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/+", "/")
    base = F.lit(re.sub("^[a-z0-9]+:/+", "/", root).rstrip("/") + "/")
    found = listed.select(F.replace(at, base, F.lit("")).alias("k"), "content")
    return keys.select(F.col(key)).distinct().join(found, F.col(key) == F.col("k"), "left").select(key, "content")


def scanned(rows: DataFrame, good: Column, name: str = "scan") -> tuple[DataFrame, Observation]:
    """The rows that pass, and an observation of n_rows and n_rejected, filled by the first action on them: rejects are counted in the same pass."""
    seen = Observation(name)
    ok = F.coalesce(good, F.lit(False))
    marked = rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(~ok).alias("n_rejected"))
    return marked.where(ok), seen
