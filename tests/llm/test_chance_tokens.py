"""Tokens that sets share by chance tie nothing, also where counters of token loads are too few to tell rare tokens."""

import random

import numpy as np
import pytest

from plumeflux.llm import ngram_join


class Full:
    """Levels of counters that all have the same load."""

    def __getitem__(self, at):
        return np.full(len(at), 4, np.uint8)


@pytest.mark.parametrize("percent", [80, 90])
def test_chance_makes_no_large_cluster(percent):
    rng = random.Random(4)
    pool = [rng.getrandbits(64) for _ in range(200_000)]
    sets = [set(rng.sample(pool, 200)) for _ in range(300)]
    drop = 100 - percent
    near = [set(rng.sample(sorted(s), 200 - drop)) | {rng.getrandbits(64) for _ in range(drop // 3)} for s in sets[:50]]
    assert all(100 * len(a & b) >= percent * len(a | b) and a != b for a, b in zip(sets, near))
    keys = [ngram_join.prefix_keys(np.array(sorted(s), np.uint64), Full(), percent).tolist() for s in sets + near]
    root, first = list(range(len(keys))), {}
    for k, own in enumerate(keys):
        for key in own:
            old, new = root[k], root[first.setdefault(key, k)]
            if old != new:
                root = [new if r == old else r for r in root]
    assert all(root[k] == root[300 + k] for k in range(50))
    assert max(root.count(r) for r in root) <= 12


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_every_barely_linked_pair_shares_a_key(percent):
    rng = random.Random(5)
    for n in (*range(1, 40), 63, 64, 65, 127, 128, 200):
        for _ in range(4):
            base = [rng.getrandbits(64) for _ in range(n)]
            a, b = set(base), set(rng.sample(base, -(-n * rng.randint(percent, 100) // 100)))
            while 100 * len(a & b) >= percent * (len(a | b) + 1):
                b.add(rng.getrandbits(64))
            assert 100 * len(a & b) >= percent * len(a | b)
            one, two = (set(ngram_join.prefix_keys(np.array(sorted(s), np.uint64), Full(), percent).tolist()) for s in (a, b))
            assert a == b or one & two


def test_many_prefixes_at_once_have_the_keys_of_each():
    rng = random.Random(6)
    sets = [np.array(sorted(rng.getrandbits(64) for _ in range(n)), np.uint64) for n in (1, 3, 9, 40, 41, 300)]
    some = [p for s in sets for p in ngram_join.prefixes(s, Full(), 50)]
    keys, owner = ngram_join.pair_keys(some)
    for k, one in enumerate(some):
        assert sorted(keys[owner == k].tolist()) == sorted(ngram_join.pair_keys([one])[0].tolist())
