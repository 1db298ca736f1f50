"""The pipeline's stages on a small table, each against what it must do to its own input."""

import corpus_pipeline

from scriptorium.llm.common import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf), name)
        kept[name] = (docs, out)
        docs = out
    assert all(out.columns == names for name, (_, out) in kept.items() if name != "token_ids")
    before, after = kept["near_dedup"]
    from tests.llm.test_operators import brute_near, brute_removed

    groups = brute_near([(r["doc_id"], r["text"]) for r in before.collect()], 5)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(d for d, _, least in groups if d == least)
    before, after = kept["passage_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    new = {r["doc_id"]: r["text"] for r in after.collect()}
    assert new == {d: t for (d, _), t in zip(rows, brute_removed([t.encode() for _, t in rows], 400, 50))}
    assert sum(new[d] != t for d, t in rows) > 0
    before, after = kept["test_items"]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaky = {r["doc_id"] for r in before.collect() if any(t in r["text"] for t in items)}
    assert leaky and not leaky & {r["doc_id"] for r in after.collect()}
    assert all(r["ids_sha256"] and r["n_tokens"] == len(r["ids"]) for r in docs.collect())


def test_odd_rows(spark, sf):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing columns and an empty table go through all stages."""
    some = corpus_pipeline.test_items(spark, corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), sf)
    good = some.where("lang = 'en' and length(text) between 900 and 3000").orderBy("doc_id").limit(3).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in good] * 2
    rows += [(None, good[0]["text"], None, None, None), (None, None, None, None, None), (1, "", "en", "", 0), (2, None, "zz", None, 5), (3, "word " * 400_000, "en", "s", 1), (4, "x" * 2_000_000, None, "s", 1)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = plain.selectExpr("*", "1 AS k", "2 AS c0", "3 AS s0", "4 AS __items", "'t' AS tie", "5 AS n_tokens", "6 AS ids")
    for docs in (plain, clashing, clashing.limit(0)):
        names, out = docs.columns, docs
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, out, sf), name)
            assert name == "token_ids" or out.columns == names
        assert sorted(r["doc_id"] for r in out.collect()) == (sorted(r["doc_id"] for r in good) if docs.take(1) else [])
