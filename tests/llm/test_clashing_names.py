"""Columns whose names the operators use themselves, and hosts of very many labels."""

import corpus_pipeline
import pytest

from plumeflux.llm import exact_dedup, url_filter

NAMES = ["n", "__digest", "__file", "__row", "copies", "_metadata", "a.b", "__doc", "__rest", "size", "__id", "__mark", "keep_id"]
SCHEMA = "doc_id long, text string, lang string, source string, ts int, " + ", ".join(f"`{c}` string" for c in NAMES)


@pytest.fixture()
def docs(spark, tmp_path):
    text = lambda k: f"text number {k // 2} " + " ".join(f"w{k // 2}x{j}" for j in range(20))
    rows = [(k, text(k), "en", "b", 0, *[f"v{k}"] * len(NAMES)) for k in range(12)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def test_exact_dedup(spark, docs, tmp_path):
    got = exact_dedup.dedup_files(spark, str(tmp_path / "docs"))
    assert got.columns == ["doc_id", *docs.columns[2:-1], "keep_id", "group_size", "kept", "text_sha256"]
    rows = {r.doc_id: r for r in got.collect()}
    assert all(rows[k].keep_id == k // 2 * 2 + 1 and rows[k].group_size == 2 and rows[k].n == f"v{k}" for k in range(12))


@pytest.mark.parametrize("stage", [corpus_pipeline.exact_copies, corpus_pipeline.near_copies, corpus_pipeline.mix])
def test_stages_keep_columns(spark, docs, stage):
    given = {tuple(r) for r in docs.collect()}
    got = stage(spark, docs, "")
    assert got.columns == docs.columns
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) <= given and len(rows) == (18 if stage is corpus_pipeline.mix else 6)
    empty = stage(spark, docs.where("doc_id < 0"), "")
    assert empty.columns == docs.columns and empty.count() == 0


def test_host_of_many_labels(spark):
    urls = [(1, f"http://{'a.' * 100_000}example.org/es/x"), (2, "http://.....org/"), (3, "s://x.com/fr/")]
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow")], "host string, path string, verdict string")
    got = url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in got) == [(1, "example.org/es/", "block"), (2, "org/", "allow"), (3, "com/fr/", "allow")]
