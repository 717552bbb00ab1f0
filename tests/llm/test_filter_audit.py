"""Filter audit: plain Python over all orders, retraction across micro-batches, odd rows."""

import itertools
import random
import re

from pyspark.sql import functions as F
from test_corpus import SCHEMA, corpus

from plumeflux.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def plain(rows, labels):
    """Masks row by row, then every order of the five filters."""
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, _, source, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > first[t],
        }
        mine = [x for x in labels if x[0] == i and i is not None]
        docs.append((source or "", fails, any(q == 1 for _, q, _ in mine), any(x == 1 for _, _, x in mine)))
    out = {}
    for order in itertools.permutations("ABCDE"):
        for part, fails, good, toxic in docs:
            gone = None
            for step, c in enumerate(order):
                row = out.setdefault((part, "".join(order), step + 1), [0] * 6)
                if gone is None and fails[c]:
                    gone = step
                    row[1] += 1
                    row[4] += good
                    row[5] += toxic
                elif fails[c]:
                    row[2] += 1
                row[0] += gone is None
                row[3] += fails[c] and sum(fails.values()) == 1
    shapley = {}
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + row[1]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def odd_rows():
    rng = random.Random(9)
    rows = corpus(60)
    rows = [(r[0], r[1] + rng.choice(["", " # ", " LOUD TEXT", " 5%"]) if r[1] else r[1], *r[2:]) for r in rows]
    rows += [(i, rng.choice(["copy of a text", "Another COPY", None]), "en", rng.choice(["a", "b", None, ""]), 0) for i in range(300, 360)]
    rows += [((1 << 53) + k, "far ids", "en", "a", 0) for k in (2, 1, 3)] + [(None, "copy of a text", "en", "a", 0)] * 2 + [(299, "Another COPY", "en", p, 0) for p in "abb"]
    rng.shuffle(rows)
    return rows


def odd_labels():
    rng = random.Random(1)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 90, 2), *range(290, 360), (1 << 53) + 1]]
    return labels + labels[:5] + [(None, 1, 1), (3, 1, 0), (3, 0, 1), (99999, 1, 1)]


def test_like_every_order_by_hand(spark):
    rows, labels = odd_rows(), odd_labels()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    docs = docs.select("*", *[F.lit(1).alias(c) for c in ("digest", "part", "flags", "n", "good", "toxic", "lone", "id")])
    known = spark.createDataFrame(labels, LABELS).select("*", F.lit(2).alias("part"), F.lit(3).alias("lone"))
    want = plain(rows, labels)
    for options in ({}, {"max_files": 1, "window_rows": 7}):
        got = filter_audit.audit(docs, known, **options)
        assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        assert sorted(map(tuple, got.collect())) == want


def test_smaller_ids_in_later_files_are_retracted(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "audit")
    labels = spark.createDataFrame([(5, 1, 0), (2, 0, 1)], LABELS)
    rows = []
    for part in ([(9, "x #", "en", "late", 0), (5, "x #", "en", "b", 0)], [(7, "x #", "en", "c", 0), (2, "x #", "en", "early", 0)], [(1, "y", "en", "b", 0)], [(2, "x #", "en", "b", 0), (0, "y", "en", "early", 0)]):
        rows += part
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        got = filter_audit.audit_files(spark, path, labels, folder=folder)
        assert sorted(map(tuple, got.collect())) == plain(rows, [(5, 1, 0), (2, 0, 1)])
    again = filter_audit.audit_files(spark, path, labels, folder=folder)  # nothing new
    assert sorted(map(tuple, again.collect())) == plain(rows, [(5, 1, 0), (2, 0, 1)])


def test_hot_text_reaches_its_state_once_a_task(spark, tmp_path):
    """A third of all rows share a text: its state gets at most one row per part, task and window."""
    rows = spark.range(0, 9000, 1, 6).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    labels = spark.createDataFrame([], LABELS)
    slim = filter_audit.failures(rows, labels, filter_audit.FILTERS, "doc_id", "text", "source")
    combined = slim.coalesce(3).mapInArrow(filter_audit.combine(100_000, 16, 4), "bucket long, digest binary, id long, part string, flags int, n bigint")
    sizes = combined.where("bucket >= 0").groupBy("digest").count().agg(F.max("count")).first()[0]
    assert sizes <= 3
    hot = {r.part: r.kept for r in filter_audit.audit(rows, labels).where("filter_order = 'EABCD' AND step = 1").collect()}
    assert hot == {"0": 3001, "1": 3000}


def test_empty_table_and_long_text(spark):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
    rows = [(1, "word " * 400_000, "en", "a", 0), (2, "x" * 2_000_000, "en", "a", 0)]
    assert sorted(map(tuple, filter_audit.audit(spark.createDataFrame(rows, SCHEMA), labels).collect())) == plain(rows, [])


