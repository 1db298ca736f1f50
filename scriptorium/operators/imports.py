"""Imports: rows of other data sets as dataset rows, files by listings, and engines that are passed in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import slug, strip
from scriptorium.operators.datasets import first_wins
from scriptorium.operators.rows import packed, unpacked


def load_rows(df: DataFrame, max_rows: int | None = None, key: str = "id", order: tuple[str, ...] = ("file_no", "line_no")) -> DataFrame:
    """Rows of several files in order, the first of each key; max_rows is the load's own limit."""
    out = first_wins(df, key, order)
    return out if max_rows is None else out.orderBy(*order).limit(max_rows)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 1, blank lines count), value of text files, which may be split: lines are counted by block first, so no task reads a whole file."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    blocks = raw.groupBy("path", "block").agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(blocks.select("path", "block", "first", before.alias("before")), ["path", "block"]).select("path", (F.col("n") - F.col("first") + F.col("before") + 1).alias("line_no"), "value")


def picture_kind(path: Column) -> Column:
    """jpg or png; empty for other files."""
    return F.regexp_extract(path, r"\.(jpg|png)\z", 1)


def images(listing: DataFrame, path: str = "path") -> DataFrame:
    """Paths of a listing that are .jpg or .png and lie in no metadata folder, ordered: .jpg before .png, each sorted."""
    found = listing.select(path).where((picture_kind(F.col(path)) != "") & ~F.col(path).rlike("(^|/)metadata/"))
    return found.orderBy(picture_kind(F.col(path)), path)


def remapped(df: DataFrame, listing: DataFrame, root: str, prefixes: tuple[str, ...], marker: str = "data/multidoc/", column: str = "image_path") -> DataFrame:
    """df with the column as a path of the listing where there is one: the path itself, then without a known prefix or from the marker on, under root; else as it is.

    Candidates are made for distinct paths and joined with the listing, so neither side is collected.
    """
    there = listing.select(F.col("path").alias("_candidate")).distinct()
    plain = F.replace(F.col("_raw"), F.lit("\\"), F.lit("/"))
    tails = [F.when(plain.startswith(p), F.concat(F.lit(root + "/"), F.ltrim(F.substr(plain, F.lit(len(p) + 1)), F.lit("/")))) for p in prefixes]
    marked = F.when(plain.contains(marker), F.concat(F.lit(f"{root}/{marker}"), F.substr(plain, F.instr(plain, F.lit(marker)) + len(marker))))
    raw = df.select(F.col(column).alias("_raw")).where("_raw is not null").distinct()
    tried = raw.select("_raw", F.posexplode(F.array(F.col("_raw"), *tails, marked)).alias("_rank", "_candidate")).where("_candidate is not null")
    best = tried.join(there, "_candidate", "left_semi").groupBy("_raw").agg(F.min_by("_candidate", "_rank").alias("_best"))
    return df.join(best, df[column] == best["_raw"], "left").select(*(F.coalesce(best["_best"], df[column]).alias(c) if c == column else df[c] for c in df.columns))


def nested_documents(text: DataFrame, listing: DataFrame, images_dir: str, limit: int | None = None) -> DataFrame:
    """id, image_path, template, fields (map) of JSON {"documents": [...]} (column value): the first annotation of each document that has a file name and a listed image; limit counts kept rows."""
    schema = "documents array<struct<_id: string, id: string, filename: string, annotations: array<struct<template: string, fields: map<string, string>>>>>"
    found = text.select(F.posexplode(F.from_json("value", schema)["documents"]).alias("pos", "d")).where(F.coalesce(F.size("d.annotations"), F.lit(0)) > 0)
    named = found.where(F.coalesce(F.col("d.filename"), F.lit("")) != "").withColumn("image_path", F.concat(F.lit(images_dir + "/"), "d.filename"))
    kept = named.join(listing.select(F.col("path").alias("image_path")).distinct(), "image_path", "left_semi")
    stem = F.regexp_replace(F.regexp_extract("d.filename", "[^/]*$", 0), r"\.[^.]*$", "")
    one = F.get(F.col("d.annotations"), F.lit(0))
    kept = kept if limit is None else kept.orderBy("pos").limit(limit)
    return kept.select(F.concat(F.lit("docxpand_"), F.coalesce("d._id", "d.id", stem)).alias("id"), "image_path", F.coalesce(F.nullif(one["template"], F.lit("")), F.lit("unknown")).alias("template"), F.coalesce(one["fields"], F.expr("map()").cast("map<string,string>")).alias("fields"))


def _two_lines(c: Column) -> Column:
    """(line1, line2) of a text: its first two lines that aren't blank, as they are; empty where there is none."""
    parts = F.filter(F.split(F.replace(c, F.lit("\r"), F.lit("")), "\n"), lambda x: strip(x) != "")
    return F.struct(F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("line1"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("line2"))


def labels(lines: DataFrame, order: str | None = None) -> DataFrame:
    """image, line1, line2 from label lines (column value): {"image", "mrz"} with both lines in one text, {"image", "line1", "line2"}, or one dictionary {image: text}; missing lines are empty. Of an image's labels the last by `order` counts, the greatest without it."""
    of = lambda k: F.get_json_object("value", f"$.{k}")
    keys = F.json_object_keys("value")
    one = F.when(F.array_contains(keys, "mrz"), _two_lines(of("mrz"))).otherwise(F.struct(F.coalesce(of("line1"), F.lit("")).alias("line1"), F.coalesce(of("line2"), F.lit("")).alias("line2")))
    named = F.array(F.struct(of("image").alias("image"), one.alias("x")))
    whole = F.transform(F.map_entries(F.from_json("value", "map<string, string>")), lambda e: F.struct(e["key"].alias("image"), _two_lines(e["value"]).alias("x")))
    at = F.col(order) if order else F.lit(0)
    found = lines.where(F.trim("value") != "").select(at.alias("at"), F.posexplode(F.when(F.array_contains(keys, "image"), named).otherwise(whole)).alias("pos", "e"))
    last = found.where("e.image is not null").groupBy(F.col("e.image").alias("image")).agg(F.max_by("e.x", F.struct("at", "pos", "e.x")).alias("x"))
    return last.select("image", "x.line1", "x.line2")


def with_truth(df: DataFrame, labelled: DataFrame, sidecars: DataFrame, image: str = "image") -> DataFrame:
    """df with line1 and line2: those of the labels, else of the sidecar files; rows without both are left out. Of several rows of an image the greatest counts, so df's rows don't multiply."""
    once = lambda t: t.groupBy(F.col("image").alias("i")).agg(F.max(F.struct("line1", "line2")).alias("x"))
    rows = packed(df, i=F.col(image))
    both = rows.join(once(labelled), "i", "left").join(once(sidecars).withColumnRenamed("x", "y"), "i", "left").where("x is not null or y is not null")
    one = F.coalesce("x", "y")
    return unpacked(both, df.columns, line1=one["line1"], line2=one["line2"])


def with_drafts(candidates: DataFrame, drafts: DataFrame, status: str, key: str = "id", order: str = "line_no") -> DataFrame:
    """Candidates to annotate (key, fields, status) with what an earlier run drafted: where drafts (key, fields, source) have a key, its fields, the given status and draft_source. Of several drafts of a key the last by `order` counts."""
    last = drafts.groupBy(F.col(key).alias("k")).agg(F.max_by(F.struct("fields", "source"), order).alias("d"))
    rows = packed(candidates, k=F.col(key), f=F.col("fields"), s=F.col("status")).join(last, "k", "left")
    there = F.col("d").isNotNull()
    return unpacked(rows, candidates.columns, fields=F.when(there, F.col("d.fields")).otherwise(F.col("f")), status=F.when(there, status).otherwise(F.col("s")), draft_source=F.when(there, F.col("d.source")))


def additions(base: DataFrame, more: DataFrame, key: str = "id", without: tuple = ()) -> DataFrame:
    """base and those rows of `more` whose key isn't in it, less the keys of `without`."""
    out = base.unionByName(more.join(base.select(key), key, "left_anti"), allowMissingColumns=True)
    return out.where(~F.coalesce(F.col(key).isin(*without), F.lit(False))) if without else out


def external_rows(samples: DataFrame, existing: DataFrame, fields: tuple[str, ...], kind: str, source: str, limit: int) -> DataFrame:
    """Rows to annotate: of the first `limit` samples (column pos; the import's own limit) those whose id is new, with empty fields."""
    new = samples.where(F.col("pos") < limit).withColumn("id", F.format_string("%s-%03d", slug(F.lit(source)), "pos")).join(existing.select("id"), "id", "left_anti")
    empty = F.struct(*(F.lit(None).cast("string").alias(f) for f in fields))
    return new.select("id", F.lit(kind).alias("document_type"), empty.alias("fields"), F.lit("needs_annotation_external").alias("status"), F.lit(source).alias("source_dataset"))


def gender_bucket(gender: Column, sex: Column, index: Column) -> Column:
    """male or female: by the gender, else by the sex (M, F, or a pair like X/M), else by whether the index is even."""
    g, s = F.lower(F.trim(gender)), F.upper(F.trim(sex))
    return F.when(g.isin("male", "female"), g).when(s.startswith("M") | s.contains("/M"), "male").when(s.startswith("F") | s.contains("/F"), "female").when(index % 2 == 0, "male").otherwise("female")


def zipped(rows: DataFrame, pictures: DataFrame, repo: str = "repo") -> DataFrame:
    """rows (repo, index, bucket) with image: the k-th row of a bucket gets the k-th image (repo, path, bucket) of that bucket.

    A bucket without images takes those of `other`. Rows beyond a bucket's images take the next of `other`, or of all where
    there is no `other`; the first row that finds none ends its repository. Order is by index, and by path within a bucket; all images
    together have .jpg before .png. A repository is numbered in one task, as its metadata file is one list.
    """
    out, rows = rows.columns, packed(rows, repo_=F.col(repo), index_=F.col("index"), bucket_=F.col("bucket")).select("row", F.col("repo_").alias(repo), F.col("index_").alias("index"), F.col("bucket_").alias("bucket"))
    by = lambda *c: Window.partitionBy(repo, *c)
    numbered = pictures.select(repo, "path", "bucket", (F.row_number().over(by("bucket").orderBy("path")) - 1).alias("k"))
    everything = pictures.select(repo, "path", F.lit("all").alias("bucket"), (F.row_number().over(by().orderBy(picture_kind(F.col("path")), "path")) - 1).alias("k"))
    pool = numbered.unionByName(everything)
    count = lambda b: F.count_if(F.col("bucket") == b)
    sizes = pictures.groupBy(repo).agg(count("male").alias("_male"), count("female").alias("_female"), count("other").alias("_other"), F.count("*").alias("_all"))
    own = F.when(F.col("bucket") == "male", F.col("_male")).otherwise(F.col("_female"))
    placed = rows.join(sizes, repo, "left").fillna(0, ["_male", "_female", "_other", "_all"]).withColumn("_rank", F.row_number().over(by("bucket").orderBy("index")) - 1)
    placed = placed.withColumn("_from", F.when(own > 0, F.col("bucket")).otherwise("other")).withColumn("_direct", F.col("_rank") < F.when(own > 0, own).otherwise(F.col("_other")))
    over = F.when(~F.col("_direct"), F.sum(F.when(F.col("_direct"), 0).otherwise(1)).over(by().orderBy("index")) - 1)
    placed = placed.withColumn("_over", over).withColumn("_lost", ~F.col("_direct") & (F.col("_over") >= F.when(F.col("_other") > 0, F.col("_other")).otherwise(F.col("_all"))))
    stop = F.min(F.when(F.col("_lost"), F.col("index"))).over(by())
    kept = placed.withColumn("_stop", stop).where("_stop is null or index < _stop")
    kept = kept.withColumn("_pool", F.when(F.col("_direct"), F.col("_from")).otherwise(F.when(F.col("_other") > 0, "other").otherwise("all"))).withColumn("_k", F.when(F.col("_direct"), F.col("_rank")).otherwise(F.col("_over")))
    images_ = pool.select(F.col(repo), F.col("path").alias("image"), F.col("bucket").alias("_pool"), F.col("k").alias("_k"))
    return unpacked(kept.join(images_, [repo, "_pool", "_k"]), out, image=F.col("image"))


class NotThere(NotImplementedError):
    """An engine that isn't implemented; its rows fail with this message."""


def unimplemented(name: str) -> Callable[[bytes], str]:
    def recognise(_: bytes) -> str:
        raise NotThere(f"engine {name} isn't implemented")

    return recognise


def run_engine(df: DataFrame, recognise: Callable[[bytes], str], key: str = "id", content: str = "content") -> DataFrame:
    """id, text, error, elapsed_ms of each row by a recogniser that is passed in; an exception fails its own row only."""

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, raw in zip(frame[key], frame[content], strict=True):
                began = time.monotonic()
                try:
                    said, error = recognise(raw), None
                except Exception as e:  # noqa: BLE001  whatever an engine raises is that row's error
                    said, error = None, str(e) or type(e).__name__
                rows.append((k, said, error, int((time.monotonic() - began) * 1000)))
            yield pd.DataFrame(rows, columns=["id", "text", "error", "elapsed_ms"])

    return df.select(key, content).mapInPandas(step, f"id {df.schema[key].dataType.simpleString()}, text string, error string, elapsed_ms long")


def unfinished(queue: DataFrame, done: DataFrame, limit: int | None = None, key: str = "id", order: str = "line_no") -> DataFrame:
    """Rows of the queue that aren't done yet, so that a prefill can go on where it stopped; limit is the run's own."""
    out = queue.join(done.select(key), key, "left_anti")
    return out if limit is None else out.orderBy(order).limit(limit)
