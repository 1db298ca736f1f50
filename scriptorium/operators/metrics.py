"""Field-level scoring of predictions, and comparison of runs. Inputs are long tables: (id, key, value) and (engine, id, key, value), one row for each key of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(F.try_divide(2 * p * r, p + r))


def per_document(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """engine, id, tp, fp, fn, field_accuracy, precision, recall, f1_score for every expected document and every engine that predicted anything.

    One join on (id, key) and one aggregate; null values are absent.
    """
    wanted = expected.where("value is not null")
    engines = F.broadcast(predicted.select("engine").distinct())  # a row for each engine
    grid = wanted.crossJoin(engines).select("engine", "id", "key", F.col("value").alias("e"), F.lit(None).cast("string").alias("p"))
    given = predicted.where("value is not null").select("engine", "id", "key", F.lit(None).cast("string").alias("e"), F.col("value").alias("p"))
    cell = grid.unionByName(given).groupBy("engine", "id", "key").agg(F.max("e").alias("e"), F.max("p").alias("p"))
    counts = cell.groupBy("engine", "id").agg(F.count_if(F.col("e") == F.col("p")).alias("tp"), F.count("p").alias("n_p"), F.count("e").alias("n_e")).where("n_e > 0")
    p, r = rate(F.col("tp"), F.col("n_p")), rate(F.col("tp"), F.col("n_e"))
    return counts.select("engine", "id", "tp", (F.col("n_p") - F.col("tp")).alias("fp"), (F.col("n_e") - F.col("tp")).alias("fn"), r.alias("field_accuracy"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1_score"))


def macro(per_doc: DataFrame) -> DataFrame:
    """Unweighted means for each engine."""
    return per_doc.groupBy("engine").agg(F.count("*").alias("n_documents"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("field_accuracy", "precision", "recall", "f1_score")))


def breakdown(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """engine, id, key, expected, predicted, match for every expected field."""
    engines = F.broadcast(predicted.select("engine").distinct())
    wanted = expected.where("value is not null").crossJoin(engines).select("engine", "id", "key", F.col("value").alias("expected"))
    return wanted.join(predicted.select("engine", "id", "key", F.col("value").alias("predicted")), ["engine", "id", "key"], "left").withColumn("match", F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False)))


def per_field(cells: DataFrame, soft: Column | None = None) -> DataFrame:
    """Correct and total of each field, its accuracy and mean soft score (that of equality, if none is given)."""
    score = soft if soft is not None else F.col("match").cast("double")
    return cells.groupBy("engine", "key").agg(F.count_if("match").alias("correct"), F.count("*").alias("total"), F.avg(F.col("match").cast("double")).alias("accuracy"), F.avg(score).alias("soft"))


def by_field(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """engine, key, correct, total, accuracy, similarity of each of the keys, also of those that no document has a truth for (zeros). cells: engine, key, match, soft."""
    counts = cells.groupBy("engine", "key").agg(F.count_if("match").alias("c"), F.count("*").alias("t"), F.avg(F.col("match").cast("double")).alias("a"), F.avg("soft").alias("s"))
    grid = cells.select("engine").distinct().select("engine", F.explode(F.array(*map(F.lit, keys))).alias("key"))  # a row for each engine and key
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return grid.join(counts, ["engine", "key"], "left").select("engine", "key", zero("c", "correct"), zero("t", "total"), zero("a", "accuracy"), zero("s", "similarity"))


def by_document(cells: DataFrame, documents: DataFrame) -> DataFrame:
    """engine, n_documents, exact, soft: means over all documents (columns engine, id). One without any truth counts as exact, and with 0 as its soft score. cells: engine, id, match, soft."""
    empty = documents.select("engine", "id", F.lit(None).cast("boolean").alias("match"), F.lit(None).cast("double").alias("soft"))
    docs = cells.select("engine", "id", "match", "soft").unionByName(empty).groupBy("engine", "id").agg(F.coalesce(F.bool_and("match"), F.lit(True)).alias("e"), F.coalesce(F.avg("soft"), F.lit(0.0)).alias("s"))
    return docs.groupBy("engine").agg(F.count("*").alias("n_documents"), F.avg(F.col("e").cast("double")).alias("exact"), F.avg("s").alias("soft"))


def per_document_exact(cells: DataFrame) -> DataFrame:
    """Share of documents with every field right, and the mean of their shares of right fields."""
    docs = cells.groupBy("engine", "id").agg(F.bool_and("match").alias("exact"), F.avg(F.col("match").cast("double")).alias("share"))
    return docs.groupBy("engine").agg(F.avg(F.col("exact").cast("double")).alias("doc_exact"), F.avg("share").alias("doc_soft"))


def compare_runs(per_doc: DataFrame, base: str, tuned: str, metric: str = "f1_score") -> DataFrame:
    """id, base, tuned, delta of the documents that both engines have."""
    one = lambda e, name: per_doc.where(F.col("engine") == e).select("id", F.col(metric).alias(name))
    return one(base, "base").join(one(tuned, "tuned"), "id").withColumn("delta", F.col("tuned") - F.col("base"))


def wins(delta: DataFrame) -> DataFrame:
    return delta.agg(F.count_if(F.col("delta") < 0).alias("base_wins"), F.count_if(F.col("delta") > 0).alias("tuned_wins"), F.count_if(F.col("delta") == 0).alias("ties"))


def worst(per_doc: DataFrame, k: int = 5) -> DataFrame:
    """The k documents with the least F1 (a top-k report)."""
    return per_doc.select("engine", "id", F.coalesce("f1_score", F.lit(0.0)).alias("f1_score")).orderBy("f1_score", "engine", "id").limit(k)


def token_dice(a: Column, b: Column) -> Column:
    """2 |A n B| / (|A| + |B|) over distinct blank-separated tokens; 0 where both are empty."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != ""))
    x, y = words(a), words(b)
    return rate(2 * F.size(F.array_intersect(x, y)), F.size(x) + F.size(y))
