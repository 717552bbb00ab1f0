"""Rows with null and repeated ids through the mix and the corpus pipeline, against brute force."""

import collections

import corpus_pipeline
import pytest
from test_corpus import SCHEMA


def same_size(n=40):
    """Rows of one size in two sources: ids all null in one, all equal in the other."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(10))
    return [(None, text(k), "en", "a", 0) for k in range(n)] + [(7, text(n + k), "en", "b", 0) for k in range(2 * n)]


def test_mix_keeps_targets_of_null_and_repeated_ids(spark, tmp_path):
    rows = same_size()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    targets = {"a": 2 * 400, "b": 1.5 * 1200 - 800}  # by hand: a stops at its cap, b takes the rest
    for given in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        got = corpus_pipeline.mix(spark, given, "").collect()
        taken = collections.Counter()
        for r in got:
            assert tuple(r) in rows
            taken[r.source] += 10
        assert all(abs(taken[s] - targets[s]) <= 5 for s in targets)
        copies = collections.Counter(map(tuple, got))
        assert all(copies[r] == 2 for r in rows if r[3] == "a") and {copies[r] for r in rows if r[3] == "b"} == {1, 2}


@pytest.mark.parametrize("missing", [True, False])
def test_pipeline_against_brute_force(spark, tmp_path, monkeypatch, missing):
    rows = same_size(12)
    rows += rows[:3] + [(k if not missing else None, f"{rows[0][1]} extra{k}", "en", "a", 0) for k in range(3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    # the classifier needs labels; every other stage runs as it is
    stages = [(n, (lambda s, d, p: d) if n == "quality classifier" else f) for n, f in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {r[1]: r for r in rows if " extra" not in r[1]}  # copies and near copies leave one text each
    sizes = collections.Counter()
    for r in left.values():
        sizes[r[3]] += 10
    pieces = collections.Counter(r.doc_id for r in got)
    want = {"a": 2 * sizes["a"], "b": 1.5 * sum(sizes.values()) - 2 * sizes["a"]}
    assert abs(10 * pieces[7] - want["b"]) <= 5 + 1
    assert abs(10 * (len(got) - pieces[7]) - want["a"]) <= 5 + 6
