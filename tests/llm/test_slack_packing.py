"""Minimum bin slack packing: exact round trip, fullest combinations against brute force, hot lengths."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from test_corpus import SCHEMA, corpus

from plumeflux.llm import slack_packing
from plumeflux.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def test_fullest_is_the_fullest():
    rng = random.Random(3)
    for _ in range(300):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 60)
        best = max((s for r in range(len(items) + 1) for c in itertools.combinations(items, r) if (s := sum(c)) <= room), default=0)
        counts = Counter(items)
        chosen = slack_packing.fullest(counts, room)
        assert sum(x * m for x, m in chosen.items()) == best
        assert all(m <= counts[x] for x, m in chosen.items())


def test_patterns_use_every_piece_once():
    rng = random.Random(5)
    counts = Counter(int(2048 * rng.random() ** 3) + 1 for _ in range(200_000)) + Counter({700: 100_000})
    patterns = slack_packing.bin_patterns(dict(counts), 2048)
    used = Counter()
    for times, chosen in patterns:
        assert sum(x * m for x, m in chosen.items()) <= 2048
        for x, m in chosen.items():
            used[x] += times * m
    assert used == counts and len(patterns) < 4 * 2048
    # lower bound: pieces above 2/3 of a sequence fill one, pieces above 1/3 half of one
    bins, least = sum(t for t, _ in patterns), sum(n * (3 * x // 2048) / 2 for x, n in counts.items())
    assert bins <= 1.002 * least


def check_layout(rows, window):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= window
    return len(held)


def test_round_trip(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = slack_packing.pack_documents(docs, PATH, window=256).collect()
    want = Counter()
    for i, text, *_ in rows:
        ids = np.array(library_ids(text), "<u4")
        over = len(ids) % 256 or 256
        bounds = [0, *range(min(over, len(ids)), len(ids) + 1, 256)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert check_layout(got, 256) <= -(-sum(r.length for r in got) // 256) + 1


def test_sequences_hold_the_ids(spark):
    texts = ["one two three", None, "", "a b c d e f g h i j k l m n o p", "one two three"]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    rows = slack_packing.sequences(docs, PATH, window=16).collect()
    pieces = Counter()
    for r in rows:
        assert len(r.input_ids) == sum(r.lengths) <= 16
        at = 0
        for n in r.lengths:
            pieces[tuple(r.input_ids[at : at + n])] += 1
            at += n
    want = Counter()
    for t in texts:
        ids = library_ids(t)
        over = len(ids) % 16
        want.update(tuple(ids[a:b]) for a, b in zip([0, *range(over or 16, len(ids), 16)], [*range(over or 16, len(ids) + 1, 16)]))
    assert pieces == want


def test_one_length_many_rows(spark):
    docs = spark.range(30_000).select("id", F.lit("the same words in every text").alias("text"), F.lit(1).alias("length"), F.lit(2).alias("rank"), F.lit(3).alias("part"))
    got = slack_packing.pack_documents(docs.withColumnRenamed("id", "doc_id"), PATH).collect()
    assert len(got) == 30_000 and check_layout(got, 2048) == -(-30_000 // (2048 // got[0].length))


def test_empty_table(spark):
    got = slack_packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() == 0


def test_long_ids_beside_null(spark):
    docs = spark.createDataFrame([((1 << 53) + 1, "one two", "en", "a", 0), (None, "three", "en", "a", 0)], SCHEMA).coalesce(1)
    assert {r.doc_id for r in slack_packing.pack_documents(docs, PATH).collect()} == {(1 << 53) + 1, None}
