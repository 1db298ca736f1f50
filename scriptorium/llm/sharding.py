"""Sharding by rendezvous hashing of stable record keys over weighted shards.

A key goes to the shard with the greatest -weight / ln(u), where u in (0, 1) comes from a hash of the key and the shard's
number. A shard's score doesn't depend on the others, so a new shard only takes rows into itself, about its share of the weight.
Slots number the rows of a shard without gaps, in the order of a hash bucket and then of id, text checksum and size: buckets are
counted first, so that no task ever holds a whole shard.

Cases: a null key is a key like any other (all its rows are in one shard); repeated rows get slots of their own, in any order
among themselves; null and empty texts have size 1; an empty table gives an empty table; extra columns are left aside by
report() and kept by assign(); clashing names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of each shard for numbering; the counts, at most shards x BUCKETS rows, are broadcast.
BUCKETS = 1024


def shard_of(key: Column, weights: list[float]) -> Column:
    """Number of the shard of a key; weights are positive, one for each shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")

    def score(i: Column, w: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, i), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return -w / F.ln(u)

    pairs = [F.struct(score(F.lit(i), F.lit(float(w))).alias("score"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]
    best = F.greatest(*pairs) if len(pairs) > 1 else pairs[0]
    return -best["i"]


def assign(docs: DataFrame, weights: list[float], key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """docs with the number of each row's shard. No shuffle."""
    return docs.withColumn(shard, shard_of(F.col(key), weights))


def report(docs: DataFrame, weights: list[float], grown: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, and grown_shard: the shard with one more of weight `grown`."""
    plain = F.coalesce(F.col(text), F.lit(""))
    shards = docs.select(F.col(key).alias("doc_id"), (F.octet_length(plain) + 1).cast("long").alias("size"), F.crc32(plain.cast("binary")).alias("text_crc32"))
    shards = shards.withColumns({"shard": shard_of(F.col("doc_id"), weights), "grown_shard": shard_of(F.col("doc_id"), [*weights, grown]), "bucket": F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BUCKETS)).cast("int")})
    counts = shards.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    numbered = shards.withColumn("number", number).join(F.broadcast(before), ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("number") - 1).alias("slot"), "grown_shard")


def write(docs: DataFrame, path: str, weights: list[float], key: str = "doc_id") -> None:
    """Write docs as Parquet, a folder for each shard; a hot shard is spread over several files."""
    assign(docs, weights, key).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(64))).repartition("shard", "_part").drop("_part").write.partitionBy("shard").parquet(path)
