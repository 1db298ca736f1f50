"""Reports over runs: evaluation sets, metric families, recognition means, epochs, extremes and samples. Limits here are the reports' own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.metrics import f1, rate


def eval_sets(sets: dict[str, list[DataFrame]]) -> DataFrame:
    """Rows of several sets, each the union of its parts, with the set's name in eval_set; columns that a part lacks are null."""
    out = None
    for name, parts in sets.items():
        for p in parts:
            named = p.withColumn("eval_set", F.lit(name))
            out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def constant_split(df: DataFrame, val_ids: tuple, key: str = "id") -> DataFrame:
    """df with split: rows with one of the ids are val, the rest (null ids too) train."""
    return df.withColumn("split", F.when(F.coalesce(F.col(key).isin(*val_ids), F.lit(False)), "val").otherwise("train"))


def queue_head(jobs: DataFrame, status: str = "queued", n: int = 1) -> DataFrame:
    """The n oldest jobs of a status; ids break ties."""
    return jobs.where(F.col("status") == status).orderBy("created_at", "id").limit(n)


def both_ends(delta: DataFrame, k: int = 10, by: str = "delta", key: str = "id") -> DataFrame:
    """The k best and the k worst rows, with end; keys break ties."""
    best = delta.orderBy(F.desc(by), key).limit(k).withColumn("end", F.lit("best"))
    return best.unionByName(delta.orderBy(by, key).limit(k).withColumn("end", F.lit("worst")))


def sample_k(df: DataFrame, k: int, key: str = "id", seed: int = 0) -> DataFrame:
    """k rows in the order of a seeded hash of their key: the same for every run and partitioning."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(k)


def families(expected: DataFrame, predicted: DataFrame, normal: Callable[[Column, Column], Column], derivable: tuple[str, ...]) -> DataFrame:
    """engine, family, n, field_accuracy, precision, recall, f1_score: means over all documents of three families, in one pass: exact, normalised, and normalised over the fields that a zone tells.

    expected: id, key, value; predicted: engine, id, key, value; normal(key, value) is a value's normal form. Documents without a
    field of a family count with zeros; without documents there are no rows.
    """
    known = lambda t, *more: t.where("value is not null").select(*more, "id", "key", "value", normal(F.col("key"), F.col("value")).alias("normal"))
    engines = F.broadcast(predicted.select("engine").distinct())  # a row for each engine
    nothing = F.lit(None).cast("string")
    cells = known(expected).crossJoin(engines).select("engine", "id", "key", F.col("value").alias("e"), F.col("normal").alias("ne"), nothing.alias("p"), nothing.alias("np"))
    cells = cells.unionByName(known(predicted, "engine").select("engine", "id", "key", nothing.alias("e"), nothing.alias("ne"), F.col("value").alias("p"), F.col("normal").alias("np")))
    # a row for each field, not for each field and family: families are told apart once their fields are numbers
    cell = cells.groupBy("engine", "id", "key").agg(*(F.max(c).alias(c) for c in ("e", "ne", "p", "np")))
    counted = lambda e, p, own: F.struct(*(F.count_if(own & c).alias(n) for n, c in (("tp", F.col(e) == F.col(p)), ("n_p", F.col(p).isNotNull()), ("n_e", F.col(e).isNotNull()), ("any", F.lit(True)))))
    told = F.coalesce(F.col("key").isin(*derivable), F.lit(False))
    kinds = {"exact": counted("e", "p", F.lit(True)), "normalised": counted("ne", "np", F.lit(True)), "derivable": counted("ne", "np", told)}
    docs = cell.groupBy("engine", "id").agg(*(c.alias(n) for n, c in kinds.items())).join(expected.select("id").distinct(), "id", "left_semi")
    docs = docs.select("engine", F.inline(F.array(*(F.struct(F.lit(n).alias("family"), F.col(n).alias("c")) for n in kinds)))).select("engine", "family", "c.*").where("any > 0")
    p, r = rate(F.col("tp"), F.col("n_p")), rate(F.col("tp"), F.col("n_e"))
    sums = docs.groupBy("engine", "family").agg(*(F.sum(c).alias(n) for n, c in (("field_accuracy", r), ("precision", p), ("recall", r), ("f1_score", f1(p, r)))))
    whole = expected.agg(F.count_distinct("id").alias("n"))  # one row
    return sums.crossJoin(F.broadcast(whole)).select("engine", "family", "n", *((F.col(c) / F.col("n")).alias(c) for c in ("field_accuracy", "precision", "recall", "f1_score")))


def recognition_means(rows: DataFrame, metrics: tuple[str, ...], digits: int = 4) -> DataFrame:
    """One row: the mean of each metric, rounded half to even (0 without rows), and n."""
    return rows.agg(*(F.coalesce(F.bround(F.avg(F.col(m).cast("double")), digits), F.lit(0.0)).alias(m) for m in metrics), F.count("*").alias("n"))


def best_epoch(history: DataFrame, run: str = "run", patience: int = 3) -> DataFrame:
    """run, epoch, loss, stopped: the first epoch with a run's least loss before it stops, and the epoch at which `patience` epochs in a row brought nothing better (null: none)."""
    own = history.select(F.col(run).alias("r"), F.col("epoch").alias("e"), F.col("loss").alias("x"))
    w = Window.partitionBy("r").orderBy("e")
    low = F.min("x").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = own.withColumn("better", low.isNull() | (F.col("x") < low))
    last = marked.withColumn("n", F.row_number().over(w)).withColumn("last", F.max(F.when(F.col("better"), F.col("n"))).over(w))
    stop = F.min(F.when(F.col("n") - F.col("last") >= patience, F.col("e"))).over(Window.partitionBy("r"))
    seen = last.withColumn("stop", stop).where("stop is null or e <= stop")
    return seen.groupBy("r").agg(F.min(F.struct("x", "e")).alias("b"), F.first("stop").alias("stopped")).select(F.col("r").alias(run), F.col("b.e").alias("epoch"), F.col("b.x").alias("loss"), "stopped")


def composition(rows: DataFrame, flags: DataFrame, by: str = "version", source: str = "source_dataset") -> DataFrame:
    """version, flag, n: rows of each version by the flag of their source; sources without one are 'none'."""
    return rows.join(flags.select(source, "flag").dropDuplicates([source]), source, "left").groupBy(by, F.coalesce("flag", F.lit("none")).alias("flag")).agg(F.count("*").alias("n"))


def tag_vocabulary(maps: DataFrame, column: str = "fields") -> DataFrame:
    """token: the opening and closing tags of all keys of a map column, each once."""
    keys = maps.select(F.explode(F.map_keys(column)).alias("k")).distinct()
    return keys.select(F.explode(F.array(F.concat(F.lit("<s_"), "k", F.lit(">")), F.concat(F.lit("</s_"), "k", F.lit(">")))).alias("token"))
