"""Top-k search where keys repeat or are null."""

import math
import random

from pyspark.sql import functions as F

from plumeflux.llm import topk


def test_repeated_and_null_keys_are_rows_of_their_own(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(0, [0.5] * 6), (0, [-0.5] * 6), (50, rows[50][1]), (None, [0.25] * 6), (None, [2.0] * 6), (7, None), (8, [1.0, None]), (9, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = topk.top_k(df.withColumns({"vec": F.lit(1), "near": F.lit(2), "shard": F.lit(3), "score": F.lit(4)}), F.pmod("vec_id", F.lit(50)) == 0, k=5)
    valid = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, i, v in valid:
        if i is not None and i % 50 == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), (j is None, j or 0)) for m, j, w in valid if m != n]
            want += [(i, r, None if none else j, -s) for r, (s, (none, j)) in enumerate(sorted(scored)[:5], 1)]
    order = lambda x: (x[0], x[1], x[3], x[2] is None, x[2] or 0)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()), key=order) == sorted(want, key=order)
    assert topk.top_k(df.limit(0), F.pmod("vec_id", F.lit(50)) == 0).count() == 0
