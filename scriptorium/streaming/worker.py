"""The polling worker as a stream: new job files are claimed once, by the checkpoint, and each micro-batch is processed and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def run_worker(spark: SparkSession, source: str, schema, process: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, once: bool = True, seconds: int = 2) -> StreamingQuery:
    """Process Parquet files as they come and append the results to sink. With once, what is there now is taken and the query ends."""
    jobs = spark.readStream.schema(schema).parquet(source)
    writer = process(jobs).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def merge_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text, n_pages: the texts of a document's pages in order, joined by a blank line; empty ones are dropped."""
    from pyspark.sql import functions as F

    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    texts = F.filter(F.transform(ordered, lambda p: p["text"]), lambda t: F.coalesce(F.trim(t), F.lit("")) != "")
    return pages.groupBy(key).agg(F.array_join(texts, "\n\n").alias("text"), F.count("*").alias("n_pages"))


def merge_results(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, fields, entities, raw_text, raw_mode, page_count: the results of a document's pages (columns page, fields, entities, raw_text) as one.

    The first page gives the record; the entities of later pages follow its own, their origin (source_field, else key) marked with
    the page's place (page2:...); texts are joined by a blank line, empty ones are dropped. A single page stays as it is, with a null
    mode. Only the pages of one document meet in a group.
    """
    from pyspark.sql import functions as F

    ordered = F.array_sort(F.collect_list(F.struct("page", "fields", "entities", "raw_text")))
    whole = pages.groupBy(key).agg(ordered.alias("p"))
    blank = lambda c: F.nullif(c, F.lit(""))
    origin = lambda e: F.coalesce(blank(e["source_field"]), blank(e["key"]), F.lit(""))
    marked = lambda p, i: F.transform(p["entities"], lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.when(i == 0, e["source_field"]).otherwise(F.concat(F.lit("page"), (i + 1).cast("string"), F.lit(":"), origin(e))).alias("source_field")))
    entities = F.flatten(F.transform("p", lambda p, i: F.coalesce(marked(p, i), F.array().cast("array<struct<key: string, value: string, source_field: string>>"))))
    texts = F.filter(F.transform("p", lambda p: p["raw_text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return whole.select(key, F.get("p", F.lit(0))["fields"].alias("fields"), entities.alias("entities"), F.array_join(texts, "\n\n").alias("raw_text"), F.when(F.size("p") > 1, "multipage").alias("raw_mode"), F.size("p").alias("page_count"))
