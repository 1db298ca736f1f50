"""Inputs that are derived from the driver's tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: What goes into a zone: one person for each customer.
PERSONS = """
SELECT c_custkey AS id, substr('UTORUSUSAGBRDEUFRA', CAST(n_nationkey % 6 AS INT) * 3 + 1, 3) AS country,
  concat(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(c_custkey % 26 AS INT) + 1, 1), 'ONES') AS surname,
  concat('ANN<', substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(c_custkey % 25 AS INT) + 1, 1)) AS given,
  concat('L', lpad(CAST(c_custkey AS STRING), 8, '0')) AS number,
  concat(lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0'), lpad(CAST(c_custkey % 31 + 1 AS STRING), 2, '0')) AS birth,
  substr('MF<', CAST(c_custkey % 3 AS INT) + 1, 1) AS sex,
  concat(lpad(CAST(25 + c_custkey % 10 AS STRING), 2, '0'), lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0'), '15') AS expiry
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

#: Expected fields of customers, and three pseudo-engines that miss, mistake or add some.
EXPECTED = """
SELECT c_custkey AS id, 'name' AS key, c_name AS value FROM customer
UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer
UNION ALL SELECT c_custkey, 'nation', concat('N', CAST(c_nationkey AS STRING)) FROM customer
UNION ALL SELECT c_custkey, 'code', CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('C', CAST(c_custkey % 1000 AS STRING)) END FROM customer"""
PREDICTED = f"""
SELECT engine, id, key, CASE WHEN (id + length(key) * n) % 5 = 0 THEN NULL WHEN (id * n + length(key)) % 4 = 0 THEN value || 'x' ELSE value END AS value
FROM ({EXPECTED}) e CROSS JOIN (SELECT 'zero_shot' AS engine, 1 AS n UNION ALL SELECT 'heuristic', 2 UNION ALL SELECT 'tuned', 3) g
UNION ALL SELECT 'zero_shot', c_custkey, 'extra', 'y' FROM customer WHERE c_custkey % 3 = 0"""

#: Dataset rows from documents, with repeated ids in a second file.
DATASET = """
SELECT CAST(doc_id AS STRING) AS id, 1 AS file_no, doc_id AS line_no, source AS source_dataset, lang AS document_type, concat('img/', CAST(doc_id % 700 AS STRING), '.png') AS image_path,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars % 9 END AS populated, doc_id % 13 = 0 AS bootstrap_template FROM documents
UNION ALL SELECT CASE WHEN doc_id % 17 = 0 THEN '' ELSE CAST(doc_id AS STRING) END, 2, doc_id + 10000000, concat(source, '-again'), CASE WHEN doc_id % 19 = 0 THEN '' ELSE lang END, CASE WHEN doc_id % 23 = 0 THEN NULL ELSE concat('img/', CAST(doc_id % 900 AS STRING), '.png') END, n_chars % 5, false FROM documents WHERE doc_id % 3 = 0"""

#: Jobs from orders.
JOBS = """
SELECT o_orderkey AS id, o_custkey AS owner, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'processing' END END AS status,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS document_type, o_orderdate AS created_at, o_orderkey % 3 = 0 AS is_mrz, o_orderkey % 5 < 3 AS is_valid,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('line one', chr(10), 'line two') END AS error FROM orders"""

#: German-style amounts from lineitem, with a second reading of each.
AMOUNTS = """
SELECT l_orderkey AS id, l_linenumber AS n, concat('$ ', CAST(CAST(l_quantity AS INT) AS STRING), '.', lpad(CAST(l_partkey % 1000 AS STRING), 3, '0'), ',', lpad(CAST(l_suppkey % 100 AS STRING), 2, '0')) AS truth,
  CASE WHEN l_partkey % 5 = 0 THEN 'n/a' ELSE concat(CAST(CAST(l_quantity AS INT) AS STRING), '.', lpad(CAST(l_partkey % 997 AS STRING), 3, '0'), ',', lpad(CAST(l_suppkey % 100 AS STRING), 2, '0')) END AS guess FROM lineitem"""


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores, in equal parts. A million customers, orders or events are a few MB of Parquet, often in one row group, which would be read, and all that is derived from them worked out, by one task or a few."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def derive(spark: SparkSession, sf_dir: str, sql: str, dealt: tuple[str, ...] = ("customer",)) -> DataFrame:
    """Run a derivation over the tables that it names. Those of `dealt` that it reads once are spread, as texts are made of them that take long to read."""
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in sql or f"JOIN {t}" in sql}
    named |= {t: spread(named[t]) for t in dealt if sql.count(f"FROM {t}") == 1}
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in named:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **named)
