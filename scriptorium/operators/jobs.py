"""Job tables: statistics, pages, export rows and the state that a transition log leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats(jobs: DataFrame) -> DataFrame:
    """One row for each owner: totals by status, success_rate (null without finished jobs) and mrz_valid_rate (null without such jobs)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return jobs.groupBy("owner").agg(F.count("*").alias("total"), *(n(s).alias(s) for s in ("queued", "processing", "done", "failed")), F.try_divide(n("done").cast("double"), (n("done") + n("failed")).cast("double")).alias("success_rate"), F.count_if("is_mrz").alias("mrz_total"), F.try_divide(F.count_if(F.col("is_mrz") & F.col("is_valid")).cast("double"), F.count_if("is_mrz").cast("double")).alias("mrz_valid_rate"))


def by_type(jobs: DataFrame) -> DataFrame:
    return jobs.where("document_type is not null").groupBy("owner", "document_type").agg(F.count("*").alias("n"))


def page(jobs: DataFrame, owner: Column | int, kind: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of an owner's jobs, newest first; the type is filtered before the page is cut, ids break ties."""
    mine = jobs.where(F.col("owner") == owner)
    mine = mine.where(F.col("document_type") == kind) if kind else mine
    return mine.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def document_type(requested: Column, result: Column) -> Column:
    """The requested type, else the result's (JSON text)."""
    return F.coalesce(F.nullif(requested, F.lit("")), F.get_json_object(result, "$.document_type"))


def export(jobs: DataFrame) -> DataFrame:
    """Rows of the CSV export: flags as yes or empty, line breaks of errors as blanks, ISO times."""
    yes = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "yes").otherwise("")
    return jobs.select("id", "status", F.coalesce("document_type", F.lit("")).alias("document_type"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), yes("is_mrz").alias("mrz"), yes("is_valid").alias("valid"), F.translate(F.coalesce("error", F.lit("")), "\n\r", "  ").alias("error"))


def latest(log: DataFrame, key: str, order: tuple[str, ...], state: str) -> DataFrame:
    """The last state of each key and the number of its transitions; a map-side aggregate, whatever the log's length."""
    return log.groupBy(key).agg(F.max_by(F.col(state), F.struct(*order)).alias(state), F.count("*").alias("n_transitions"))
