"""One query for each operator of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, decontaminate, lexical_search, licences, near_dups, quality, sharding, simhash, suffix_dedup, token_counts, token_store, vector_codes, warc
from scriptorium.llm.common import NULL_KEY, new_path, small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, write, and read every document back through the index."""
    store = token_store.write(table(spark, sf_dir, "documents"), new_path(spark, "tokens"))
    places = token_store.lookup(store, store.entries(spark).select("key", "copy"))
    found = token_store.read(store, places, digests=True)
    return found.select(F.when(F.col("key") != NULL_KEY, F.col("key")).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.size("faults").cast("long").alias("n_faults"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), ids=False, digests=True)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns by strings of 400 bytes; n_passages and n_passage_bytes by over 50 words, whatever their bytes."""
    return suffix_dedup.report(table(spark, sf_dir, "documents"), words=50)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"), [1.0] * 16)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "fallback_share", "entropy")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, found again in flat files by their separators."""
    path = new_path(spark, "flat")
    order = token_counts.write_flat(table(spark, sf_dir, "documents"), path)
    files = [r["file"] for r in order.select("file").distinct().collect()]  # a row for each file of 128 MB
    return order.join(token_counts.scan(spark, path, files), ["file", "nth"]).select("doc_id", "n_tokens")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_ids, op2_warc, op3_bpe, op4_licences, op5_near_dups, op6_suffix_dedup, op7_sharding, op8_token_counts, op9_quality, op10_decontaminate, op11_lexical_search, op12_simhash, op13_vector_codes)}


#: Five hexadecimal digits are four of base 32.
_DIGEST = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1) for i in range(32)], '')"
WARC_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT *, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS one FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_DIGEST} AS payload_digest, CASE WHEN page_id = one THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> one THEN one END AS refers_to, CAST(0 AS BIGINT) AS n_faults FROM f"""
NEAR_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(m.least, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m.least, doc_id)) AS kept FROM n LEFT JOIN m ON m.a = doc_id"""

SEARCH_SQL = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents),
tf AS MATERIALIZED (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL), g AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS length FROM n),
m AS (SELECT doc_id, 100 - 50 + (50 * n * n_docs) // length AS m FROM n, g), i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
d AS (SELECT w, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, g WHERE w IN (SELECT w FROM i) GROUP BY w, n_docs),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM i JOIN d USING (w) JOIN tf USING (w) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""


def _codes_sql(rounds: int = 4) -> str:
    """Brute-force assignment to all entries in each round; distances stay exact in doubles."""
    parts = ["""v AS (SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        """p AS MATERIALIZED (SELECT vec_id, label, part, q[part * (len(q) // 4) + 1:(part + 1) * (len(q) // 4)] AS x FROM v, (SELECT unnest(range(4)) AS part))""",
        """c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM p QUALIFY e < 256)"""]
    apart = "list_sum([(p.x[i] - c.x[i]) * (p.x[i] - c.x[i]) for i in range(1, len(c.x) + 1)])"
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT p.vec_id, p.label, p.part, p.x, CAST(min({apart} * 256 + c.e) AS BIGINT) AS m FROM p JOIN c{r} c ON c.part = p.part GROUP BY ALL)")
        if r < rounds:
            parts.append(f"u{r} AS (SELECT part, m % 256 AS e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT part, m, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM a{r}) GROUP BY ALL)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT part, e, list(x ORDER BY i) AS x FROM u{r} GROUP BY ALL) n ON n.part = c.part AND n.e = c.e)")
    return f"""WITH {", ".join(parts)}, h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS h FROM c{rounds}),
f AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(m % 256)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM f, h"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express whole; hashes, tokenizers, models and byte strings are compared with brute force in tests/llm."""
    return {"op2_warc": WARC_SQL, "op5_near_dups": NEAR_SQL, "op11_lexical_search": SEARCH_SQL, "op13_vector_codes": _codes_sql()}
