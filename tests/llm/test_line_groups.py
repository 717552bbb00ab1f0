"""Lines that share a segment in large numbers: whole links, few candidates."""

import random

import pytest
from pyspark.sql import functions as F

from plumeflux.llm import line_dedup


def family(n, seed):
    """``n`` lines that begin alike and differ in many words, and for some of them a copy with two edits."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzждю", k=5))
    head = " ".join(word() for _ in range(12))
    lines = [f"{head} {' '.join(word() for _ in range(20))}" for _ in range(n)]
    near = {}
    for k in range(0, n, 10):
        at = rng.randrange(len(lines[k]))
        changed = lines[k][:at] + rng.choice("qж") + lines[k][at + 1 :]
        near[k] = changed + "x" if rng.random() < 0.5 else "z" + changed
    return lines, near


def test_shared_segment_of_many_lines_makes_few_pairs(spark):
    lines, near = family(2000, 7)
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)] + [(10_000 + k, x) for k, x in near.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(got) == len(lines) + len(near)
    for k in range(len(lines)):
        assert got[k].class_id == k and got[k].kept and got[k].links == (k in near)
    for k in near:
        assert got[10_000 + k].class_id == k and not got[10_000 + k].kept
    # all lines share one segment: 2,000 x 2,000 pairs without the marks
    texts = docs.select(F.xxhash64("text").alias("h1"), line_dedup.character_marks(F.col("text"), 2).alias("marks"))
    shared = texts.select("h1", F.lit(1).cast("bigint").alias("key"), F.lit(True).alias("indexed"))
    assert line_dedup.narrowed_pairs(shared, texts).count() < 3 * len(lines)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines_within_the_edits_share_a_mark(spark, edits):
    rng = random.Random(edits)
    alphabet = "ab é𝄞ж."
    rows = []
    for _ in range(400):
        a = "".join(rng.choices(alphabet, k=rng.randint(0, 25)))
        b = list(a)
        for _ in range(edits):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "𝄞"])
        rows.append((a, "".join(b)))
    marks = [line_dedup.character_marks(F.col(c), edits) for c in "ab"]
    got = spark.createDataFrame(rows, "a string, b string").select(F.arrays_overlap(*marks).alias("met")).collect()
    assert all(r.met for r in got)


def test_odd_lines(spark):
    """Empty tables, null texts, clashing column names and a very long line with a near copy."""
    schema = "doc_id long, text string, line string, h1 string, links string, n string"
    assert line_dedup.dedup_lines(spark.createDataFrame([], schema)).count() == 0
    long_line = " ".join(f"w{k * 7919 % 100_003}" for k in range(20_000))
    rows = [(1, long_line, "a", "b", "c", "d"), (2, long_line[:50_000] + "#" + long_line[50_001:], None, "b", "c", "d"), (None, None, "a", "b", "c", "d"), (3, "", "a", "b", "c", "d"), (3, "", "a", "b", "c", "d")]
    got = sorted(line_dedup.dedup_lines(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r.doc_id or 0, r.line_no))
    assert [(r.doc_id, r.class_id, r.links, r.kept) for r in got] == [(None, None, 0, True), (1, 1, 1, True), (2, 1, 1, False), (3, None, 0, False), (3, None, 0, False)]


def test_many_near_lines_make_few_pairs(spark, monkeypatch):
    """Variants of one line with few words apart agree in segments and marks: whole links, candidates far below all pairs."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgж", k=6))
    base = [word() for _ in range(24)]

    def variant():
        out = list(base)
        for at in rng.sample(range(24), 2):
            out[at] = word()
        return " ".join(out)

    lines = [variant() for _ in range(600)]
    for k in range(60):  # a replaced, a missing or a doubled character, or both of two
        x, at = lines[10 * k], rng.randrange(1, 80)
        x = x[:at] + ["Q", "", x[at] * 2][k % 3] + x[at + 1 :]
        lines.append(x if k % 2 else x[:100] + "#" + x[101:])
    monkeypatch.setattr(line_dedup, "PAIRED", 8)
    table = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h1"), "line").cache()
    name = {r.h1: r.line for r in table.collect()}
    pairs = {tuple(sorted((name[r.a], name[r.b]))) for r in line_dedup.split_groups(table, 2).collect()}
    want = {tuple(sorted((lines[10 * k], lines[600 + k]))) for k in range(60)}
    assert want <= pairs and len(pairs) < 5 * len(lines)  # 217,470 pairs in all
    # the former way, by marks: tens of thousands
    texts = table.select("h1", line_dedup.character_marks(F.col("line"), 2).alias("marks"))
    shared = table.select("h1", F.lit(1).cast("bigint").alias("key"), F.lit(True).alias("indexed"))
    assert line_dedup.narrowed_pairs(shared, texts).count() > 10 * len(pairs)


@pytest.mark.parametrize("edits", [1, 2])
def test_split_groups_lose_no_link(spark, monkeypatch, edits):
    rng = random.Random(edits)
    base = "".join(rng.choices("ab é𝄞ж.", k=23))
    lines = {base}
    for _ in range(120):
        b = list(base)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "𝄞"])
        lines.add("".join(b))
    monkeypatch.setattr(line_dedup, "PAIRED", 2)
    table = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h1"), "line").cache()
    name = {r.h1: r.line for r in table.collect()}
    pairs = {tuple(sorted((name[r.a], name[r.b]))) for r in line_dedup.split_groups(table, edits).collect()}
    every = spark.createDataFrame([(a, b) for a in lines for b in lines if a < b], "a string, b string")
    want = {(r.a, r.b) for r in every.where(line_dedup.within(F.col("a"), F.col("b"), edits)).collect()}
    assert want and want <= pairs
