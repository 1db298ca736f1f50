"""Queries that write files of the tables and read them back, and reports, each with the same result as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import datasets, imports, reports
from scriptorium.plans.fixtures import DATASET, derive
from scriptorium.plans.queries import query, table
from scriptorium.sources import metadata, tables
from scriptorium.sources import reports as report_files
from scriptorium.sources.shared import new_folder
from scriptorium.streaming import worker

_NOTES = "SELECT doc_id, text, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS lang FROM documents"


@query(f"SELECT doc_id, md5(text) AS text_md5, lang FROM ({_NOTES})")
def written_lines(spark, sf_dir):
    """Whole texts as JSON lines and back; a line that can't be read would fail the query."""
    path = new_folder(spark, "lines")
    tables.write_jsonl(derive(spark, sf_dir, _NOTES), path)
    return tables.read_jsonl(spark, path, "doc_id long, text string, lang string").select("doc_id", F.md5("text").alias("text_md5"), "lang")


_LINES = "SELECT event_id, CASE event_id % 9 WHEN 0 THEN '  ' WHEN 1 THEN concat('{\"event_id\": ', CAST(event_id AS STRING)) WHEN 2 THEN 'no object' WHEN 3 THEN concat('{\"event_id\": ', CAST(event_id AS STRING), ', \"other\": 1}') ELSE concat('{\"event_id\": ', CAST(event_id AS STRING), ', \"kind\": \"', event_type, '\"}') END AS value FROM events"


@query("SELECT event_id, CASE WHEN event_id % 9 > 3 THEN event_type END AS kind FROM events WHERE event_id % 9 > 2")
def readable_lines(spark, sf_dir):
    """Lines of which some are blank, cut off or no objects: only the others are rows."""
    path = new_folder(spark, "odd-lines")
    derive(spark, sf_dir, _LINES).select("value").write.text(path)
    return tables.read_jsonl(spark, path, "event_id long, kind string", fail=False)


@query(f"SELECT id, CAST(file_no - 1 AS INT) AS file_no, source_dataset FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_no, line_no) AS rn FROM ({DATASET})) WHERE rn = 1 OR id = ''")
def rows_of_files(spark, sf_dir):
    """Two files of JSON lines in their order: the first row of each id, and all without an id."""
    rows = derive(spark, sf_dir, DATASET)
    paths = [new_folder(spark, "first"), new_folder(spark, "second")]
    for n, path in enumerate(paths):
        tables.write_jsonl(rows.where(F.col("file_no") == n + 1).select("id", "source_dataset"), path)
    return imports.load_rows(tables.read_jsonl_files(spark, paths, "id string, source_dataset string")).select("id", "file_no", "source_dataset")


_PEOPLE = "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 > 0 THEN concat(CASE c_custkey % 3 WHEN 0 THEN 'Имя, ' WHEN 1 THEN 'Čapek ' ELSE 'Lou ' END, c_mktsegment) END AS name, CASE WHEN c_custkey % 10 > 1 THEN CAST(c_custkey AS STRING) END AS code, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender FROM customer"
_CYRILLIC = "replace(name, 'Č', 'Ч')"


@query(f"""WITH p AS ({_PEOPLE}) SELECT 'bom' AS kind, coalesce(name, '') AS name, coalesce(code, '') AS code, CAST(NULL AS STRING) AS gender FROM p WHERE coalesce(name, code) IS NOT NULL
UNION ALL SELECT 'cyrillic', coalesce({_CYRILLIC}, ''), coalesce(code, ''), NULL FROM p WHERE coalesce(name, code) IS NOT NULL UNION ALL SELECT 'groups', name, code, gender FROM p""")
def metadata_rows(spark, sf_dir):
    """Customers as CSV with a byte order mark and semicolons, as CSV in a Cyrillic code page with commas, and as JSON grouped by gender, read in one scan. A file holds up to 1,000 rows."""
    people = derive(spark, sf_dir, _PEOPLE)
    folders = [new_folder(spark, f"metadata-{k}") for k in ("bom", "cyrillic", "groups")]
    csv = lambda df, sep, encoding: df.write.option("header", True).option("sep", sep).option("encoding", encoding).option("maxRecordsPerFile", 1000)
    csv(people.select(F.col("name").alias("\ufeffname"), "code"), ";", "UTF-8").csv(folders[0])
    as_bytes = F.translate(F.expr(_CYRILLIC), "ИмяЧ", "ИмяЧ".encode("cp1251").decode("latin-1"))  # Spark writes no such code page itself
    csv(people.select(as_bytes.alias("name"), "code"), ",", "ISO-8859-1").csv(folders[1])
    side = lambda g: F.collect_list(F.when(F.col("gender") == g, F.struct("name", "code"))).alias(g)
    people.groupBy(F.floor(F.col("id") / 1000).alias("part")).agg(side("male"), side("female")).drop("part").write.option("maxRecordsPerFile", 1).json(folders[2])
    found = metadata.read_rows(spark, folders)
    at = lambda k: F.try_element_at("fields", F.lit(k)).alias(k)
    return found.where("error is null").select(F.regexp_extract("path", "/metadata-([a-z]+)-", 1).alias("kind"), at("name"), at("code"), at("gender"))


_LISTED = "SELECT concat('set', CAST(page_id % 40 AS STRING), CASE page_id % 5 WHEN 0 THEN '/metadata/' WHEN 1 THEN '/metadata.old/' ELSE '/' END, CAST(page_id AS STRING), CASE page_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' ELSE '.csv' END) AS path, concat('set', CAST(page_id % 40 AS STRING)) AS data_set FROM pages"


@query(f"SELECT data_set, min(path) AS metadata_path FROM ({_LISTED}) WHERE contains(path, '/metadata/') GROUP BY data_set")
def metadata_paths(spark, sf_dir):
    return metadata.discovered(derive(spark, sf_dir, _LISTED), "data_set")


@query(f"SELECT path FROM ({_LISTED}) WHERE (path LIKE '%.jpg' OR path LIKE '%.png') AND NOT contains(path, '/metadata/')")
def listed_images(spark, sf_dir):
    return imports.images(derive(spark, sf_dir, _LISTED))


_NAMED = "SELECT doc_id AS id, concat('set', CAST(doc_id % 40 AS STRING), '/', CAST(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN '.jpg' ELSE '.png' END) AS image_path FROM documents"


@query(f"SELECT id, image_path FROM ({_NAMED}) WHERE image_path IN (SELECT path FROM ({_LISTED}))")
def rows_with_files(spark, sf_dir):
    return tables.existing(derive(spark, sf_dir, _NAMED), derive(spark, sf_dir, _LISTED)).select("id", "image_path")


@query("SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error'")
def worker_results(spark, sf_dir):
    """What the polling worker leaves of files of events: it takes what is there, once, and ends."""
    jobs, sink = new_folder(spark, "jobs"), new_folder(spark, "results")
    events = table(spark, sf_dir, "events")
    events.write.parquet(jobs)
    process = lambda df: df.where("event_type <> 'error'").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    worker.run_worker(spark, jobs, events.schema, process, sink, new_folder(spark, "worker-checkpoint")).awaitTermination()
    return spark.read.schema("event_id long, user_id long, k long").parquet(sink)


_SOURCES = "SELECT doc_id AS id, CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN concat('Russian-', source) WHEN doc_id % 4 = 1 THEN concat('printed-', source) ELSE source END AS source_dataset, CASE WHEN doc_id % 7 > 0 THEN lang END AS nationality, substr('MF', CAST(doc_id % 2 AS INT) + 1, 1) AS sex, CASE WHEN doc_id % 5 > 1 THEN lang WHEN doc_id % 5 = 1 THEN '' END AS surname, concat('img/', CAST(doc_id AS STRING), CASE doc_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '' ELSE '.jpg' END) AS image_path FROM documents"


@query(f"""WITH s AS (SELECT *, coalesce(source_dataset, 'None') AS g FROM ({_SOURCES})),
v AS (SELECT g, 'nationalities' AS name, coalesce(nationality, 'None') AS value FROM s UNION ALL SELECT g, 'sexes', sex FROM s UNION ALL SELECT g, 'image_extensions', lower(regexp_extract(image_path, '[.][^./]*$')) FROM s),
c AS (SELECT g, name, value, count(*) AS n FROM v GROUP BY g, name, value), m AS (SELECT g, name, string_agg(concat('"', value, '":', n), ',' ORDER BY value) AS body FROM c GROUP BY g, name),
k AS (SELECT g, string_agg(concat('"', name, '":{{', body, '}}'), ',' ORDER BY name) AS counts FROM m GROUP BY g),
r AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE surname <> '') AS n_surname, count(nationality) AS n_nationality FROM s GROUP BY g)
SELECT r.g AS source_dataset, contains(lower(r.g), 'russian') AS is_russian, contains(lower(r.g), 'printed-') AS is_printed_variant, concat('{{"counts":{{', counts, '}},"coverage":{{', concat_ws(',', CASE WHEN n_nationality > 0 THEN concat('"nationality":', n_nationality) END, CASE WHEN n_surname > 0 THEN concat('"surname":', n_surname) END), '}},"n_rows":', r.n, ',"source_dataset":"', r.g, '"}}') AS report FROM r JOIN k ON k.g = r.g""")
def source_profiles(spark, sf_dir):
    """The profile of each source, written as a JSON report and read back."""
    rows = derive(spark, sf_dir, _SOURCES)
    counters = {"nationalities": F.col("nationality"), "sexes": F.col("sex"), "image_extensions": F.lower(F.regexp_extract("image_path", "[.][^./]*$", 0))}
    path = new_folder(spark, "profile")
    report_files.write_json(datasets.profile(rows, "source_dataset", counters, ("surname", "nationality")), path)
    source = F.get_json_object("value", "$.source_dataset")
    return spark.read.text(path).select(source.alias("source_dataset"), *(c.alias(k) for k, c in datasets.source_flags(source).items()), F.col("value").alias("report"))


_IMAGES = "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 17 > 0 THEN concat(lang, CASE WHEN doc_id % 2 = 0 THEN '/' ELSE chr(92) END, CAST(doc_id % 500 AS STRING), '.png') END AS image_path FROM documents"


@query(f"""WITH i AS ({_IMAGES}), d AS (SELECT DISTINCT image_path FROM i WHERE image_path <> '')
SELECT concat_ws(',', concat('even=', count(*) FILTER (WHERE doc_id % 2 = 0)), concat('odd=', count(*) FILTER (WHERE doc_id % 2 = 1))) AS n_rows, (SELECT count(*) FROM d) AS image_count,
(SELECT string_agg(r, ',' ORDER BY r) FROM (SELECT DISTINCT string_split(replace(image_path, chr(92), '/'), '/')[1] AS r FROM d)) AS image_roots FROM i""")
def bundle_manifest(spark, sf_dir):
    i = derive(spark, sf_dir, _IMAGES)
    m = report_files.manifest({"even": i.where("doc_id % 2 = 0"), "odd": i.where("doc_id % 2 = 1"), "none": i.where("doc_id is null")})
    named = F.transform(F.map_entries("n_rows"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select(F.array_join(named, ",").alias("n_rows"), "image_count", F.array_join("image_roots", ",").alias("image_roots"))


@query(f"""WITH r AS ({DATASET}), k AS (SELECT DISTINCT id FROM r WHERE id IS NOT NULL), o AS (SELECT id, row_number() OVER (ORDER BY md5(concat('7:', id)), id) AS place, count(*) OVER () AS n FROM k)
SELECT r.id AS id, file_no, line_no, CASE WHEN place <= greatest(1, CAST(floor(n * CAST(0.15 AS DOUBLE)) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM r LEFT JOIN o ON o.id = r.id""")
def shuffled_split(spark, sf_dir):
    """An exact share of the ids, with all their rows."""
    return datasets.shuffle_split(derive(spark, sf_dir, DATASET), 0.15, seed=7).select("id", "file_no", "line_no", "split")


@query("SELECT doc_id, source FROM documents ORDER BY md5(concat('3:', CAST(doc_id AS STRING))), doc_id LIMIT 50")
def sampled_rows(spark, sf_dir):
    """Fifty documents: a sampling operator."""
    return reports.sample_k(table(spark, sf_dir, "documents"), 50, "doc_id", 3).select("doc_id", "source")


@query("SELECT doc_id AS id, CASE WHEN doc_id = max(doc_id) OVER () THEN 'val' ELSE 'train' END AS split FROM documents")
def rescued_split(spark, sf_dir):
    """A split without val rows: the last one becomes val."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("train").alias("split"))
    return datasets.fallback_split(docs, "id")


_PRIORITIES = {"src1": 2, "again": 1, "src2": 2, "src3": 4}


@query("SELECT id, source_dataset FROM (" + DATASET + ") ORDER BY " + "CASE " + " ".join(f"WHEN contains(source_dataset, '{p}') THEN {n}" for p, n in _PRIORITIES.items()) + " ELSE 99 END, populated DESC NULLS LAST, id, line_no LIMIT 25")
def first_to_curate(spark, sf_dir):
    """The first 25 rows of the order in which rows are to be looked at (a top-k report)."""
    return datasets.prioritized(derive(spark, sf_dir, DATASET), "source_dataset", _PRIORITIES, order=("line_no",)).limit(25).select("id", "source_dataset")


_TYPED = "SELECT event_id, CAST(floor(event_id / 500) AS BIGINT) AS part, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE concat(event_type, ' ', CAST(event_id AS STRING)) END AS value FROM events"


@query(f"SELECT part, row_number() OVER (PARTITION BY part ORDER BY event_id) AS line_no, value FROM ({_TYPED})")
def line_numbers(spark, sf_dir):
    """Lines of files of 500 events by their places; blank lines count."""
    path = new_folder(spark, "numbered")
    derive(spark, sf_dir, _TYPED).repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(path)
    found = imports.numbered_lines(spark, path)
    return found.select(F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("long").alias("part"), "line_no", "value")


@query("SELECT count(*) FILTER (WHERE page_id % 10 = 0) AS n_missing, CAST(coalesce(sum(octet_length(encode(coalesce(html, ''))) + 1), 0) AS BIGINT) AS n_bytes FROM pages")
def blob_totals(spark, sf_dir):
    """Files by their keys: what they hold, and the keys without a file. A file holds up to 200 pages."""
    root, pages = new_folder(spark, "blobs"), table(spark, sf_dir, "pages")
    pages.select(F.coalesce("html", F.lit("")).alias("value"), (F.col("page_id") % 4).alias("part")).write.option("maxRecordsPerFile", 200).partitionBy("part").text(root)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_extract("path", "part=[^/]*/[^/]*$", 0).alias("key"))
    keys = there.unionByName(pages.where("page_id % 10 = 0").select(F.concat(F.lit("none/"), F.col("page_id").cast("string")).alias("key")))
    return metadata.blobs(spark, root, keys).agg(F.count_if(F.col("content").isNull()).alias("n_missing"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("n_bytes"))


@query("""WITH r AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang ORDER BY n DESC, source, lang LIMIT 25)
SELECT concat('## Sources', chr(10), chr(10), '| source | lang | n |', chr(10), '|-|-|-|', chr(10), string_agg(concat('| ', replace(coalesce(source, ''), '|', chr(92) || '|'), ' | ', coalesce(lang, ''), ' | ', n, ' |', chr(10)), '' ORDER BY n DESC, source, lang)) AS report FROM r""")
def markdown_report(spark, sf_dir):
    """The largest sources as a report for people, cut at 25 rows (a top-k report)."""
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("source"), F.asc_nulls_last("lang"))
    return spark.createDataFrame([(report_files.markdown(counts, "Sources"),)], "report string")
