"""From recognised text to a zone's record: a chain of stages, each with its status, in which a failed stage passes its row on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import mrz
from scriptorium.operators.rows import bound, packed


def pipeline(df: DataFrame, text: str, key: str, this_year: int, countries: dict[str, str] | None = None, confusions: dict[str, str] = mrz.CONFUSIONS, most_edits: int = 2) -> DataFrame:
    """key, split, corrected, n_edits, l1, l2, valid, stage and fields of each text; key tells the rows apart.

    split: two_lines, first_only, second_only or none. n_edits: substitutions in the second line (0: it was valid, -1: none helps, null: there
    is no second line); the corrected line replaces it only if there were any. valid: all digits of both lines. stage is the
    last one that the row passed: none, split, corrected, valid.
    """
    found = bound(packed(df, k=F.col(key), t=F.col(text).cast("string")).select("k", "t"), z=mrz.split_lines(F.coalesce("t", F.lit(""))))
    lines = found.select("k", F.col("z.l1").alias("l1"), F.col("z.l2").alias("l2"))
    repaired = mrz.repair_pairs if most_edits > 1 else mrz.repair
    fixed = repaired(lines.where("l2 != ''"), "l2", "k", confusions).select("k", "fixed", F.col("n_edits").cast("int").alias("n_edits"))
    joined = lines.join(fixed, "k", "left").select("k", "l1", F.when(F.col("n_edits") > 0, F.col("fixed")).otherwise(F.col("l2")).alias("l2"), "n_edits")
    both = (F.col("l1") != "") & (F.col("l2") != "")
    split = F.when(both, "two_lines").when(F.col("l1") != "", "first_only").when(F.col("l2") != "", "second_only").otherwise("none")
    read = bound(joined, v=F.when(both, mrz.validate(F.col("l1"), F.col("l2"))["valid"]), f=F.when(split != "none", mrz.parse(F.col("l1"), F.col("l2"), this_year, countries)))
    valid = F.coalesce("v", F.lit(False))
    stage = F.when(valid, "valid").when(F.col("n_edits") >= 0, "corrected").when(split != "none", "split").otherwise("none")
    return read.select(F.col("k").alias(key), split.alias("split"), F.coalesce(F.col("n_edits") > 0, F.lit(False)).alias("corrected"), "n_edits", "l1", "l2", valid.alias("valid"), stage.alias("stage"), F.col("f").alias("fields"))


def shares(zones: DataFrame) -> DataFrame:
    """stage, n and share of the rows whose last passed stage it is."""
    counts = zones.groupBy("stage").agg(F.count("*").alias("n"))
    whole = zones.agg(F.count("*").alias("whole"))  # one row
    return counts.crossJoin(F.broadcast(whole)).select("stage", "n", (F.col("n") / F.col("whole")).alias("share"))
