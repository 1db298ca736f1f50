"""Queries over the driver's tables, each with the same result as SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import dates, jsonops, mrz, payload, text, trees
from scriptorium.operators import datasets, jobs, metrics
from scriptorium.plans.fixtures import AMOUNTS, DATASET, EXPECTED, JOBS, PERSONS, PREDICTED, derive

THIS_YEAR = 2025
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# zones


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zone for each customer: true lines, and lines of which every third has one character mistaken."""
    p = derive(spark, sf_dir, PERSONS)
    l1, l2 = mrz.build(*(F.col(c) for c in ("country", "surname", "given", "number", "birth", "sex", "expiry")))
    built = p.select("id", "country", l1.alias("l1"), l2.alias("t2"))
    at = (F.col("id") % 9 + 1).cast("int")
    changed = lambda t: F.concat(F.substr(t, F.lit(1), at - 1), F.when(F.substr(t, at, F.lit(1)) == "0", "O").otherwise("0"), F.substr(t, at + 1))
    return built.withColumn("l2", mrz.let(F.col("t2"), lambda t: F.when(F.col("id") % 3 == 0, changed(t)).otherwise(t)))


def _cd(s: str) -> str:
    """DuckDB's check digit of a string expression, as a character."""
    v = "CASE WHEN substr({s}, i, 1) = '<' THEN 0 WHEN substr({s}, i, 1) BETWEEN '0' AND '9' THEN ascii(substr({s}, i, 1)) - 48 ELSE ascii(substr({s}, i, 1)) - 55 END".replace("{s}", s)
    return f"CAST(list_sum([({v}) * [7, 3, 1][CAST((i - 1) % 3 AS INT) + 1] for i in range(1, length({s}) + 1)]) % 10 AS VARCHAR)"


_HEAD = f"concat(number, {_cd('number')}, country, birth, {_cd('birth')}, sex, expiry, {_cd('expiry')}, '<<<<<<<<<<<<<<', '0')"
_COMPOSITE = "concat(substr(h, 1, 10), substr(h, 14, 7), substr(h, 22, 22))"
ZONES = f"""heads AS (SELECT *, {_HEAD} AS h FROM ({PERSONS})),
built AS (SELECT id, country, rpad(concat('P<', country, surname, '<<', given), 44, '<') AS l1, concat(h, {_cd(_COMPOSITE)}) AS t2 FROM heads),
zones AS (SELECT *, CASE WHEN id % 3 = 0 THEN concat(substr(t2, 1, CAST(id % 9 AS INT)), CASE WHEN substr(t2, CAST(id % 9 AS INT) + 1, 1) = '0' THEN 'O' ELSE '0' END, substr(t2, CAST(id % 9 AS INT) + 2)) ELSE t2 END AS l2 FROM built)"""


def _valid(s: str) -> str:
    c = f"concat(substr({s}, 1, 10), substr({s}, 14, 7), substr({s}, 22, 22))"
    return f"({_cd(f'substr({s}, 1, 9)')} = substr({s}, 10, 1) AND {_cd(f'substr({s}, 14, 6)')} = substr({s}, 20, 1) AND {_cd(f'substr({s}, 22, 6)')} = substr({s}, 28, 1) AND {_cd(c)} = substr({s}, 44, 1))"


@query(f"WITH {ZONES} SELECT country, count(*) AS n, count(*) FILTER (WHERE {_valid('l2')}) AS n_valid FROM zones GROUP BY country")
def mrz_valid_by_country(spark, sf_dir):
    z = zones(spark, sf_dir).withColumn("valid", mrz.validate(F.col("l1"), F.col("l2"))["valid"])
    return z.groupBy("country").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"))


_ISO = "strftime(try_strptime(concat({c}, {d}), '%Y%m%d'), '%Y-%m-%d')"


@query(f"""WITH {ZONES} SELECT id, replace(substr(l2, 1, 9), '<', '') AS document_number, concat(chr(CAST(65 + id % 26 AS INT)), 'ONES') AS surname, concat('ANN ', chr(CAST(65 + id % 25 AS INT))) AS given_names,
country AS nationality_code, {_ISO.format(c="CASE WHEN CAST(substr(l2, 14, 2) AS INT) > 25 THEN '19' ELSE '20' END", d='substr(l2, 14, 6)')} AS date_of_birth, nullif(substr(l2, 21, 1), '<') AS sex, {_ISO.format(c="'20'", d='substr(l2, 22, 6)')} AS date_of_expiry FROM zones""")
def mrz_parse_fields(spark, sf_dir):
    joined = zones(spark, sf_dir).select("id", mrz.split_lines(F.concat_ws("\n", F.lit("noise"), "l1", F.lit(""), "l2")).alias("z"))
    f = mrz.parse(F.col("z.l1"), F.col("z.l2"), THIS_YEAR)
    return joined.select("id", f.alias("f")).select("id", *(f"f.{c}" for c in ("document_number", "surname", "given_names", "nationality_code", "date_of_birth", "sex", "date_of_expiry")))


_TABLE = ", ".join(f"('{k}', {i}, '{a}')" for k, alts in mrz.CONFUSIONS.items() for i, a in enumerate(alts))


@query(f"""WITH {ZONES}, bad AS (SELECT id, l2 FROM zones WHERE NOT {_valid('l2')}),
tried AS (SELECT id, p * 10 + t.n AS rank, concat(substr(l2, 1, CAST(p AS INT) - 1), t.alt, substr(l2, CAST(p AS INT) + 1)) AS cand FROM bad, range(1, 45) r(p), (VALUES {_TABLE}) t(ch, n, alt) WHERE substr(l2, CAST(p AS INT), 1) = t.ch),
good AS (SELECT id, min_by(cand, rank) AS cand, count(DISTINCT cand) AS n FROM tried WHERE {_valid('cand')} GROUP BY id)
SELECT z.id, coalesce(g.cand, z.l2) AS fixed, CASE WHEN {_valid('z.l2')} THEN 0 WHEN g.id IS NOT NULL THEN 1 ELSE -1 END AS n_edits, coalesce(g.n, 0) AS n_candidates FROM zones z LEFT JOIN good g ON z.id = g.id""")
def mrz_repair_singles(spark, sf_dir):
    return mrz.repair(zones(spark, sf_dir), "l2", "id")


@query(f"WITH {ZONES} SELECT country, avg(len([i for i in range(1, 45) if substr(l1, i, 1) = substr(d1, i, 1)]) + len([i for i in range(1, 45) if substr(l2, i, 1) = substr(t2, i, 1)])) / 88.0 AS char_accuracy, avg(CASE WHEN l2 = t2 THEN 1.0 ELSE 0.0 END) AS line2_exact FROM (SELECT *, CASE WHEN id % 4 = 0 THEN replace(l1, 'O', '0') ELSE l1 END AS d1 FROM zones) GROUP BY country")
def mrz_char_accuracy(spark, sf_dir):
    damaged = F.when(F.col("id") % 4 == 0, F.replace("l1", F.lit("O"), F.lit("0"))).otherwise(F.col("l1"))
    z = zones(spark, sf_dir).withColumn("a", mrz.char_accuracy(damaged, F.col("l2"), F.col("l1"), F.col("t2")))
    return z.groupBy("country").agg(F.avg("a").alias("char_accuracy"), F.avg((F.col("l2") == F.col("t2")).cast("double")).alias("line2_exact"))


_CENTURY = "CASE WHEN CAST(substr(birth, 1, 2) AS INT) > 25 THEN '19' ELSE '20' END"


def _dotted(pivot: int) -> str:
    return f"concat(substr(birth, 5, 2), '.', substr(birth, 3, 2), '.', CASE WHEN CAST(substr(birth, 1, 2) AS INT) >= {pivot} THEN '19' ELSE '20' END, substr(birth, 1, 2))"


@query(f"SELECT id, {_ISO.format(c=_CENTURY, d='birth')} AS this_year, {_dotted(30)} AS pivot_30, {_dotted(50)} AS pivot_50 FROM ({PERSONS})")
def mrz_dates_three_pivots(spark, sf_dir):
    b = F.col("birth")
    return derive(spark, sf_dir, PERSONS).select("id", dates.mrz_iso(b, THIS_YEAR).alias("this_year"), dates.mrz_dotted(b, 30).alias("pivot_30"), dates.mrz_dotted(b, 50).alias("pivot_50"))


# scoring


def fields(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return derive(spark, sf_dir, EXPECTED), derive(spark, sf_dir, PREDICTED)


_SCORES = f"""e AS ({EXPECTED}), p AS ({PREDICTED}), eng AS (SELECT DISTINCT engine FROM p),
ne AS (SELECT id, count(value) AS n_e FROM e GROUP BY id), np AS (SELECT engine, id, count(value) AS n_p FROM p GROUP BY engine, id),
tp AS (SELECT p.engine, p.id, count(*) AS tp FROM p JOIN e ON p.id = e.id AND p.key = e.key AND p.value = e.value GROUP BY p.engine, p.id),
c AS (SELECT eng.engine, ne.id, coalesce(tp.tp, 0) AS tp, ne.n_e, coalesce(np.n_p, 0) AS n_p FROM ne CROSS JOIN eng LEFT JOIN np ON np.engine = eng.engine AND np.id = ne.id LEFT JOIN tp ON tp.engine = eng.engine AND tp.id = ne.id WHERE ne.n_e > 0),
pr AS (SELECT engine, id, tp, n_p - tp AS fp, n_e - tp AS fn, CASE WHEN n_p = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / n_p END AS precision, tp::DOUBLE / n_e AS recall FROM c),
s AS (SELECT engine, id, tp, fp, fn, recall AS field_accuracy, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1_score FROM pr)"""


@query(f"WITH {_SCORES} SELECT * FROM s")
def field_metrics(spark, sf_dir):
    return metrics.per_document(*fields(spark, sf_dir))


@query(f"WITH {_SCORES} SELECT engine, count(*) AS n_documents, round(avg(field_accuracy), 9) AS field_accuracy, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1_score), 9) AS f1_score FROM s GROUP BY engine")
def field_metrics_by_engine(spark, sf_dir):
    m = metrics.macro(metrics.per_document(*fields(spark, sf_dir)))
    return m.select("engine", "n_documents", *(F.round(c, 9).alias(c) for c in ("field_accuracy", "precision", "recall", "f1_score")))


@query(f"WITH {_SCORES} SELECT a.id, a.f1_score AS base, b.f1_score AS tuned, b.f1_score - a.f1_score AS delta FROM s a JOIN s b ON a.id = b.id WHERE a.engine = 'heuristic' AND b.engine = 'tuned'")
def run_delta(spark, sf_dir):
    return metrics.compare_runs(metrics.per_document(*fields(spark, sf_dir)), "heuristic", "tuned")


@query(f"WITH {_SCORES} SELECT count(*) FILTER (WHERE b.f1_score < a.f1_score) AS base_wins, count(*) FILTER (WHERE b.f1_score > a.f1_score) AS tuned_wins, count(*) FILTER (WHERE b.f1_score = a.f1_score) AS ties FROM s a JOIN s b ON a.id = b.id WHERE a.engine = 'heuristic' AND b.engine = 'tuned'")
def win_tie(spark, sf_dir):
    return metrics.wins(metrics.compare_runs(metrics.per_document(*fields(spark, sf_dir)), "heuristic", "tuned"))


@query(f"WITH {_SCORES} SELECT engine, id, f1_score FROM s ORDER BY f1_score, engine, id LIMIT 5")
def worst_k(spark, sf_dir):
    return metrics.worst(metrics.per_document(*fields(spark, sf_dir)), 5)


_CELLS = f"cells AS (SELECT g.engine, e.id, e.key, e.value AS expected, p.value AS predicted, coalesce(e.value = p.value, false) AS match FROM ({EXPECTED}) e CROSS JOIN (SELECT DISTINCT engine FROM ({PREDICTED})) g LEFT JOIN ({PREDICTED}) p ON p.engine = g.engine AND p.id = e.id AND p.key = e.key WHERE e.value IS NOT NULL)"


@query(f"WITH {_CELLS} SELECT * FROM cells")
def field_breakdown(spark, sf_dir):
    return metrics.breakdown(*fields(spark, sf_dir)).select("engine", "id", "key", "expected", "predicted", "match")


@query(f"WITH {_CELLS} SELECT engine, key, count(*) FILTER (WHERE match) AS correct, count(*) AS total, round(avg(CASE WHEN match THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM cells GROUP BY engine, key")
def per_field_accuracy(spark, sf_dir):
    return metrics.per_field(metrics.breakdown(*fields(spark, sf_dir))).select("engine", "key", "correct", "total", F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {_CELLS}, d AS (SELECT engine, id, bool_and(match) AS exact, avg(CASE WHEN match THEN 1.0::DOUBLE ELSE 0.0 END) AS share FROM cells GROUP BY engine, id) SELECT engine, round(avg(CASE WHEN exact THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS doc_exact, round(avg(share), 9) AS doc_soft FROM d GROUP BY engine")
def doc_exact_soft(spark, sf_dir):
    m = metrics.per_document_exact(metrics.breakdown(*fields(spark, sf_dir)))
    return m.select("engine", F.round("doc_exact", 9).alias("doc_exact"), F.round("doc_soft", 9).alias("doc_soft"))


_NUM = "TRY_CAST(replace(regexp_replace(lower(trim({c})), '[$ .]', '', 'g'), ',', '.') AS DOUBLE)"


@query(f"WITH a AS (SELECT id, n, {_NUM.format(c='truth')} AS t, {_NUM.format(c='guess')} AS g FROM ({AMOUNTS})) SELECT id, n, t AS truth, g AS guess, CASE WHEN g IS NULL OR t IS NULL THEN 0.0::DOUBLE WHEN t = 0 THEN CASE WHEN g = 0 THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, 1 - abs(g - t) / abs(t)) END AS score FROM a")
def amount_scores(spark, sf_dir):
    a = derive(spark, sf_dir, AMOUNTS).select("id", "n", dates.amount(F.col("truth")).alias("truth"), dates.amount(F.col("guess")).alias("guess"))
    return a.withColumn("score", dates.amount_similarity(F.col("guess"), F.col("truth")))


# datasets


@query(f"SELECT id, file_no, line_no, source_dataset FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_no, line_no) AS rn FROM ({DATASET})) WHERE rn = 1 OR id = ''")
def dedup_first_wins(spark, sf_dir):
    return datasets.first_wins(derive(spark, sf_dir, DATASET)).select("id", "file_no", "line_no", "source_dataset")


_SPLIT = "SELECT *, CASE WHEN count(*) OVER (PARTITION BY coalesce(source_dataset, 'None')) >= 2 AND row_number() OVER (PARTITION BY coalesce(source_dataset, 'None') ORDER BY coalesce(id, 'None') DESC, file_no DESC, line_no DESC) = 1 THEN 'val' ELSE 'train' END AS split FROM ({t})"
#: The data set with repeated rows at the end of some groups.
REPEATED = f"SELECT * FROM ({DATASET}) UNION ALL SELECT id, file_no, line_no + 50000000, source_dataset, document_type, image_path, populated, bootstrap_template FROM ({DATASET}) WHERE file_no = 1 AND (TRY_CAST(id AS BIGINT) % 10 = 9 OR id LIKE '99%')"


@query(f"SELECT id, line_no, source_dataset, split FROM ({_SPLIT.format(t=REPEATED)})")
def last_of_group_split(spark, sf_dir):
    return datasets.last_of_group_split(derive(spark, sf_dir, REPEATED)).select("id", "line_no", "source_dataset", "split")


@query(" UNION ALL ".join(f"SELECT '{f}' AS family, split, count(*) AS n, max(CASE WHEN split = 'val' THEN line_no END) AS last_val FROM ({_SPLIT.format(t=f'SELECT * FROM ({REPEATED}) WHERE {w}')}) GROUP BY split" for f, w in (("v1", "true"), ("v2", "document_type <> 'fr'"), ("v3", "document_type <> 'fr' AND NOT contains(source_dataset, 'src1')"))))
def split_families(spark, sf_dir):
    other = F.col("document_type") != "fr"
    found = datasets.split_families(derive(spark, sf_dir, REPEATED), {"v1": F.lit(True), "v2": other, "v3": other & ~F.col("source_dataset").contains("src1")})
    return found.groupBy("family", "split").agg(F.count("*").alias("n"), F.max(F.when(F.col("split") == "val", F.col("line_no"))).alias("last_val"))


@query(f"""WITH s AS ({_SPLIT.format(t=REPEATED)}), m AS (SELECT DISTINCT 'id' AS kind, id AS value, id, split FROM s WHERE id IS NOT NULL UNION ALL SELECT DISTINCT 'image', image_path, id, split FROM s WHERE id IS NOT NULL AND image_path IS NOT NULL)
SELECT a.kind, a.value, a.id, a.split, count(*) AS n_links FROM m a JOIN m b ON a.kind = b.kind AND a.value = b.value AND a.split <> b.split AND (a.kind = 'id' OR a.id <> b.id) GROUP BY ALL""")
def split_leakage(spark, sf_dir):
    """Which rows leak: a row for each id of each side of a leak, with how many ids of the other side it is linked with."""
    s = datasets.last_of_group_split(derive(spark, sf_dir, REPEATED))
    return datasets.leak_members(s.where("split = 'train'"), s.where("split = 'val'"))


@query("""SELECT d.doc_id AS id, CASE WHEN l.quality = 1 AND l.toxic = 0 AND d.n_chars >= 500 THEN 'train' WHEN l.quality = 1 THEN 'eval' ELSE 'manual' END AS route, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id NOT IN (SELECT CAST(item_id AS BIGINT) FROM benchmark WHERE item_id IS NOT NULL)""")
def curation_route(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    known = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    routed = datasets.route(rows.join(known, "doc_id", "left_anti"), (F.col("quality") == 1) & (F.col("toxic") == 0) & (F.col("n_chars") >= 500), F.col("quality") == 1)
    return routed.select(F.col("doc_id").alias("id"), "route", "n_chars")


@query(f"SELECT id, line_no, source_dataset FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no) AS rn FROM ({DATASET}) WHERE id <> '' AND TRY_CAST(id AS BIGINT) % 2 = 0 AND NOT (TRY_CAST(id AS BIGINT) % 5 = 0)) WHERE rn = 1")
def promote_new(spark, sf_dir):
    queue = derive(spark, sf_dir, DATASET)
    number = F.col("id").try_cast("long")
    return datasets.promote(queue, queue.where(number % 2 == 0), queue.where(number % 5 == 0)).select("id", "line_no", "source_dataset")


@query(f"""WITH d AS (SELECT *, min(line_no) OVER (PARTITION BY id) AS f FROM ({DATASET})) SELECT line_no, issue FROM (
SELECT line_no, CASE WHEN id = '' THEN 'missing id' WHEN line_no > f THEN 'duplicate id' END AS issue FROM d
UNION ALL SELECT line_no, CASE WHEN image_path IS NULL THEN 'missing image_path' WHEN TRY_CAST(regexp_extract(image_path, '([0-9]+)', 1) AS INT) % 4 = 0 THEN 'image file does not exist' END FROM d
UNION ALL SELECT line_no, CASE WHEN document_type = '' THEN 'missing document_type' END FROM d UNION ALL SELECT line_no, CASE WHEN populated IS NULL THEN 'fields must be an object' WHEN populated = 0 THEN 'all fields are empty' END FROM d
UNION ALL SELECT line_no, CASE WHEN populated IS NOT NULL AND bootstrap_template THEN 'bootstrap template' END FROM d) WHERE issue IS NOT NULL""")
def dataset_issues(spark, sf_dir):
    d = derive(spark, sf_dir, DATASET)
    there = d.select("image_path").where(F.regexp_extract("image_path", "([0-9]+)", 1).try_cast("int") % 4 != 0)
    return datasets.issues(d, there)


@query(f"SELECT source_dataset, 'document_type' AS field, document_type AS value, count(*) AS n FROM ({DATASET}) GROUP BY ALL")
def split_summary(spark, sf_dir):
    return datasets.counter(derive(spark, sf_dir, DATASET), "source_dataset", "document_type")


@query(f"SELECT source_dataset, count(*) AS n_rows, count(*) FILTER (WHERE document_type <> '') AS n_document_type, count(image_path) AS n_image_path, count(*) FILTER (WHERE id <> '') AS n_id FROM ({DATASET}) GROUP BY source_dataset")
def source_profile(spark, sf_dir):
    return datasets.coverage(derive(spark, sf_dir, DATASET), "source_dataset", ("document_type", "image_path", "id"))


# text lines

_LINES = r"SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


def lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query(f"""WITH v AS (SELECT doc_id, pos, nullif(trim(regexp_replace(line, '[ \\t\\r]+', ' ', 'g')), '') AS value FROM ({_LINES})), f AS (SELECT doc_id, upper(value) AS u, min_by(value, pos) AS value, min(pos) AS first_at FROM v WHERE value IS NOT NULL GROUP BY doc_id, upper(value))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_at) AS pos, value FROM f""")
def ordered_distinct_lines(spark, sf_dir):
    ls = F.split(F.coalesce("text", F.lit("")), "\n")
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.distinct_lines(ls)).alias("pos", "value"))
    return found.select("doc_id", (F.col("pos") + 1).alias("pos"), "value")


_CLEAN = "[x for x in [trim(y) for y in string_split(text, chr(10))] if x <> '']"


@query(f"WITH d AS (SELECT doc_id, {_CLEAN} AS l FROM documents), h AS (SELECT doc_id, l, [i for i in range(1, len(l)) if contains(upper(l[i]), 'THE') OR contains(upper(l[i]), 'DER')] AS hits FROM d) SELECT doc_id, CASE WHEN len(hits) > 0 THEN l[hits[1] + 1] END AS value FROM h")
def value_after_marker(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.lines(F.col("text")).alias("l"))
    return d.select("doc_id", text.value_after(F.col("l"), ("THE", "DER")).alias("value"))


@query(r"""SELECT doc_id, length(trim(text)) < 40 OR len(regexp_extract_all(text, '[A-Za-z0-9_]+')) < 8 OR len([x for x in [trim(y) for y in string_split(text, chr(10))] if x <> '']) < 3 AS sparse,
len(w) >= 4 AND len(list_distinct(w)) <= greatest(2, len(w) // 2) AS repetitive FROM (SELECT *, [x for x in [trim(y) for y in string_split(text, chr(10))] if x <> ''] AS w FROM documents)""")
def sparse_or_repetitive(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.too_sparse(t).alias("sparse"), text.repetitive(text.lines(t)).alias("repetitive"))


@query("WITH w AS (SELECT source, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS word FROM documents), c AS (SELECT source, word, count(*) AS n FROM w GROUP BY source, word) SELECT source, word, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rn FROM c) WHERE rn = 1")
def mode_min_tie(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("word"))
    return datasets.most_frequent(words, "source", "word")


@query("SELECT page_id, CASE WHEN strpos(html, '<title>') > 0 AND strpos(substr(html, strpos(html, '<title>') + 7), '</title>') > 0 THEN trim(substr(html, strpos(html, '<title>') + 7, strpos(substr(html, strpos(html, '<title>') + 7), '</title>') - 1)) END AS title, len(regexp_extract_all(html, '<p>')) AS n_p FROM pages")
def tag_extract(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", text.tag(h, "title").alias("title"), F.size(F.regexp_extract_all(h, F.lit("<p>"), F.lit(0))).cast("long").alias("n_p"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_salvage(spark, sf_dir):
    """Objects in noisy text whose end is cut off and mended."""
    noisy = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("answer: "), F.expr("left(props, length(props) - 1)"), F.lit(",")).alias("t"))
    return noisy.select("event_id", F.get_json_object(jsonops.object_text(F.col("t")), "$.k").cast("long").alias("k"))


# jobs


@query(f"""SELECT owner, count(*) AS total, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed,
CASE WHEN count(*) FILTER (WHERE status IN ('done', 'failed')) > 0 THEN count(*) FILTER (WHERE status = 'done')::DOUBLE / count(*) FILTER (WHERE status IN ('done', 'failed')) END AS success_rate, count(*) FILTER (WHERE is_mrz) AS mrz_total,
CASE WHEN count(*) FILTER (WHERE is_mrz) > 0 THEN count(*) FILTER (WHERE is_mrz AND is_valid)::DOUBLE / count(*) FILTER (WHERE is_mrz) END AS mrz_valid_rate FROM ({JOBS}) GROUP BY owner""")
def job_stats(spark, sf_dir):
    return jobs.stats(derive(spark, sf_dir, JOBS))


@query(f"SELECT owner, document_type, count(*) AS n FROM ({JOBS}) WHERE document_type IS NOT NULL GROUP BY ALL")
def job_types(spark, sf_dir):
    return jobs.by_type(derive(spark, sf_dir, JOBS))


@query(f"SELECT id, status, created_at FROM ({JOBS}) WHERE owner = 7 ORDER BY created_at DESC, id DESC LIMIT 5 OFFSET 2")
def job_page(spark, sf_dir):
    return jobs.page(derive(spark, sf_dir, JOBS), 7, offset=2, limit=5).select("id", "status", "created_at")


@query(f"SELECT id, status, coalesce(document_type, '') AS document_type, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, CASE WHEN is_mrz THEN 'yes' ELSE '' END AS mrz, CASE WHEN is_valid THEN 'yes' ELSE '' END AS valid, replace(coalesce(error, ''), chr(10), ' ') AS error FROM ({JOBS})")
def job_export(spark, sf_dir):
    return jobs.export(derive(spark, sf_dir, JOBS))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, count(*) AS n_transitions FROM events GROUP BY user_id")
def queue_latest_state(spark, sf_dir):
    return jobs.latest(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), "event_type")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE trim(text) <> '') AS text, count(*) AS n_pages FROM conversations GROUP BY conv_id")
def merge_pages(spark, sf_dir):
    from scriptorium.streaming import worker

    return worker.merge_pages(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), "text"), "conv_id")


# field maps, dates and gates

_CARDS = """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'driver_license' WHEN 1 THEN 'passport' ELSE 'id_card' END AS kind, c_name AS name,
  concat('no Y', lpad(CAST(c_custkey AS STRING), 7, '0'), ' z') AS number, CASE WHEN c_custkey % 5 = 0 THEN '__' ELSE c_mktsegment END AS segment FROM customer"""


@query(f"""WITH c AS (SELECT *, CASE WHEN segment = '__' THEN NULL ELSE segment END AS s FROM ({_CARDS})), l AS (
SELECT id, CASE WHEN kind = 'driver_license' THEN 'license_number' ELSE 'document_number' END AS key, CASE WHEN kind = 'id_card' THEN number ELSE regexp_extract(number, 'Y[0-9]+') END AS value FROM c
UNION ALL SELECT id, 'surname', name FROM c UNION ALL SELECT id, CASE WHEN kind = 'passport' THEN 'Addr' ELSE 'address' END, s FROM c) SELECT * FROM l WHERE value IS NOT NULL""")
def payload_fields(spark, sf_dir):
    c = derive(spark, sf_dir, _CARDS)
    fields = F.create_map(F.lit("Document-Number"), "number", F.lit("Family name"), F.lit("N/A"), F.lit("LASTNAME"), "name", F.lit("Addr"), "segment")
    return c.select("id", F.explode(payload.normalize(F.col("kind"), fields)).alias("key", "value"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%d.%m.%Y') AS date FROM orders")
def scored_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("d"))
    spelled = F.when(F.col("id") % 3 == 0, F.date_format("d", "d/M/yyyy")).when(F.col("id") % 3 == 1, F.date_format("d", "d MMM yyyy")).otherwise(F.date_format("d", "dd-MM-yyyy"))
    return o.select("id", dates.dotted(spelled).alias("date"))


@query("SELECT o_orderkey AS id, concat(strftime(o_orderdate, '%m/%d/'), CASE WHEN o_orderkey % 3 = 0 THEN concat('20', strftime(o_orderdate, '%y')) ELSE strftime(o_orderdate, '%Y') END) AS date FROM orders")
def mended_dates(spark, sf_dir):
    """Years that were read as 29xx, dates without separators, and whole ones."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("d"))
    spelled = F.when(F.col("id") % 3 == 0, F.date_format("d", "MM/dd/'29'yy")).when(F.col("id") % 3 == 1, F.concat(F.lit("on "), F.date_format("d", "MMddyyyy"))).otherwise(F.date_format("d", "MM/dd/yyyy"))
    return o.select("id", dates.identity_date(spelled, F.array(F.lit("no token"))).alias("date"))


@query("SELECT l_orderkey AS id, l_linenumber AS n, year(o_orderdate) <= year(l_shipdate) AS birth, year(o_orderdate) >= year(l_shipdate) AS expiry FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def better_dates(spark, sf_dir):
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    slashed = both.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("new"), F.date_format("l_shipdate", "MM/dd/yyyy").alias("old"))
    read = slashed.select("id", "n", dates.ordinal(F.col("new")).alias("new"), dates.ordinal(F.col("old")).alias("old"))
    return read.select("id", "n", *(dates.better_ordinal(F.col("new"), F.col("old"), birth).alias(name) for name, birth in (("birth", True), ("expiry", False))))


@query("SELECT page_id, CASE WHEN coalesce(length(html), 0) = 0 THEN 400 WHEN length(html) > 2000 THEN 413 WHEN page_id % 4 = 0 THEN 415 ELSE 200 END AS code, len(regexp_extract_all(coalesce(html, ''), '<p>')) >= 5 AS loops FROM pages")
def upload_and_loop_gates(spark, sf_dir):
    mime = F.when(F.col("page_id") % 4 == 0, "text/x").otherwise("text/html")
    return table(spark, sf_dir, "pages").select("page_id", payload.upload_code(F.length("html"), mime, 2000, ("text/html",)).alias("code"), payload.loops(F.replace("html", F.lit("<p>"), F.lit("<s_p>")), 5).alias("loops"))


@query("SELECT event_id, concat('e.k=', json_extract_string(props, '$.k')) AS flat FROM events")
def flat_json(spark, sf_dir):
    nested = F.concat(F.lit('{"e": '), F.col("props"), F.lit(', "none": null}'))
    maps = table(spark, sf_dir, "events").select("event_id", trees.flatten(nested).alias("m"))
    return maps.select("event_id", F.concat(F.lit("e.k="), F.try_element_at("m", F.lit("e.k"))).alias("flat"))


@query()
def amount_digit_ratio(spark, sf_dir):
    a = derive(spark, sf_dir, AMOUNTS)
    return a.select("id", "n", trees.digit_similarity(F.col("guess"), F.col("truth")).alias("score"))


@query()
def mrz_repair_pairs(spark, sf_dir):
    return mrz.repair_pairs(zones(spark, sf_dir), "l2", "id")


from scriptorium.plans import answers, identity, operations, records, scores, storage  # noqa: E402,F401  they register their queries
