"""Near copies with null and repeated ids, against brute force."""

import collections
import random

from test_corpus import SCHEMA

from plumeflux.llm import ngram_join


def test_near_copies_by_row(spark, tmp_path):
    rng = random.Random(3)
    fresh = lambda: [f"v{rng.randrange(10**6)}" for _ in range(60)]
    near = lambda w: w[:-1] + ["other"]
    a, b, c = fresh(), fresh(), fresh()
    texts = [(1, a), (2, near(a)), (2, fresh()), (None, b), (None, near(b)), (None, fresh()), (5, c), (5, near(c)), (6, [])]
    docs = spark.createDataFrame([(k, " ".join(w), "en", "a", 0) for k, w in texts], SCHEMA)
    docs.write.parquet(str(tmp_path / "docs"))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, w in texts]
    groups = list(range(len(texts)))
    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                groups = [groups[j] if g == groups[i] else g for g in groups]
    got = [r.text for r in ngram_join.keep_representatives(spark.read.parquet(str(tmp_path / "docs"))).collect()]
    kept = collections.Counter(groups[[" ".join(w) for _, w in texts].index(t)] for t in got)
    assert kept == collections.Counter(set(groups))
