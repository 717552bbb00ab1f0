"""Corpus operators against brute force on small fixtures with nulls, empty and long texts, ties and repeats."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumeflux.llm import exact_dedup, license_scan, line_dedup, mixing, ngram_join, packing, quality, token_counts, topk, url_filter
from plumeflux.llm.queries import URL_RULES, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def corpus(n=90):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(60)] + ["The", "éa", "don't", "x,y"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(vocab, k=rng.randint(1, 80)))
        if rows and rng.random() < 0.4:  # copies, near copies
            parts = (rng.choice(rows)[1] or "a").split(" ")
            for _ in range(rng.randint(0, 2)):
                parts[rng.randrange(len(parts))] = rng.choice(vocab)
            text = " ".join(parts)
        rows.append((i, text, "en", rng.choice(["a", "b", None]), 0))
    rows += [(200, None, None, None, None), (201, "", "", "", 0), (202, " \t\n", "en", "a", 1), (None, "one two", "en", "a", 1)]
    rows += [(203, "Foo BAR\nfoo", "en", "b", 1), (204, "foo bar\nFOO", "en", "b", 1), (205, "long " * 30000, "en", "c", 1), rows[3], rows[3]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, docs, tmp_path):
    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    groups = collections.defaultdict(list)
    for i, text, *_ in corpus():
        groups[(text or "").translate(LOWER)].append(i)
    want = sorted((str(i), str(max((x for x in g if x is not None), default=None)), len(g)) for g in groups.values() for i in g)
    for digest in (exact_dedup.sha256, lambda c: F.pmod(F.xxhash64(c), F.lit(3)).cast("string")):
        got = exact_dedup.dedup_files(spark, path, digest=digest, max_files=1).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_state_goes_on_between_runs(spark, tmp_path):
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    own = exact_dedup.state_session(spark)
    for ids in ([1, 2], [3]):
        spark.createDataFrame([(i, "same") for i in ids], "doc_id long, text string").write.mode("append").parquet(path)
        _, state = exact_dedup.run_state(exact_dedup.stream_files(own, path), checkpoint=checkpoint)
    assert [(r["at"]["id"], r["n"]) for r in state.collect()] == [(3, 3)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_automaton_and_line_classes(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abé ", k=rng.randint(0, 30))) for _ in range(25)]

    def change(s, k):
        s = list(s)
        for _ in range(k):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        return "".join(s)

    lines = sorted({change(b, k) for b in base for k in (0, 1, 2, 3)})
    pairs = [(a, b) for a in lines for b in rng.sample(lines, 4)] + [(a, change(a, 2)) for a in lines]
    for limit in (1, 2):
        got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.within(F.col("a"), F.col("b"), limit).alias("w"))
        assert all(r.w == (edits(r.a, r.b) <= limit) for r in got.collect())
    rows = [(i, "\n".join(rng.sample(lines, 3))) for i in range(40)] + [(None, lines[0]), (500, None), (501, "")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 2, 6).collect()
    flat = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    root = {x: x for _, _, x in flat}
    links = collections.Counter()
    for a in root:
        for b in root:
            if a < b and min(len(a), len(b)) >= 6 and edits(a, b) <= 2:
                links[a] += 1
                links[b] += 1
                keep, drop = root[a], root[b]
                root = {k: keep if v == drop else v for k, v in root.items()}
    order = lambda t: (t[0] is not None, t[0] or 0, t[1])
    head = {}
    for i, k, x in flat:
        head[root[x]] = min(head.get(root[x], (i, k)), (i, k), key=order)
    want = [(i, k, len(x), *head[root[x]], links[x], head[root[x]] == (i, k)) for i, k, x in flat]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("filter_bytes", [1 << 20, 0])
def test_url_filter(spark, filter_bytes):
    urls = ["http://A.example.org/en/12?x", "https://x.com/fr/", "http://com/de", "http://org", "u://org/", "ftp://Notorg/", None, "", "nope", "a://b?c://org/", "s://example.org/es/#q", "s://example.org/es/#q"]
    pages = spark.createDataFrame([(k % 9 or None, u, "h") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = url_filter.filter_urls(pages, rules, filter_bytes=filter_bytes).collect()

    def judge(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path, host = re.match(r"[^?#]*", rest[len(host) :])[0], host.translate(LOWER)
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fit)[2:] if fit else (None, "allow"))

    assert sorted(map(str, map(tuple, got))) == sorted(str((k % 9 or None, *judge(u))) for k, u in enumerate(urls))


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_ngram_components(docs, width, percent):
    rows = corpus()
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
                old = root[a]
                root = [root[b] if r == old else r for r in root]
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    want = sorted(str((i, len(sets[k]), least.get(root[k]))) for k, (i, *_) in enumerate(rows))
    assert sorted(str(tuple(r)) for r in ngram_join.ngram_components(docs, width, percent).collect()) == want
    cut = ngram_join.ngram_components(docs, width, percent, block_tokens=50)  # clusters in bands and blocks
    assert sorted(str(tuple(r)) for r in cut.collect()) == want


def test_prefix_tree_and_prefix_keys():
    rng = random.Random(3)
    for _ in range(40):
        percent, base = rng.choice([50, 80, 90, 100]), [rng.getrandbits(64) for _ in range(rng.randint(1, 200))]
        sets = []
        for _ in range(rng.randint(1, 15)):
            s = set(base) - set(rng.sample(base, rng.randint(0, len(base) // 9)))
            s |= {rng.getrandbits(64) for _ in range(rng.randint(0, len(base) // 9))}
            sets.append(np.array(sorted(s), np.uint64))
        plain = [set(x.tolist()) for x in sets]
        want = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if 100 * len(plain[i] & plain[j]) >= percent * len(plain[i] | plain[j])}
        got = {(k, int(j)) for k, found in ngram_join.PrefixTree(sets).join(sets, percent, cells=rng.choice([1, 10**6])) for j in found}
        assert got == want
        levels = np.zeros(1 << ngram_join.LOAD_BITS, np.uint8)
        at, load = np.unique(np.concatenate(sets) >> np.uint64(64 - ngram_join.LOAD_BITS), return_counts=True)
        levels[at.astype(int)] = 12 * np.log2(load)
        for i, j in want:
            keys = [set(ngram_join.prefix_keys(sets[k], levels, percent).tolist()) for k in (i, j)]
            assert i == j or sets[i].tolist() == sets[j].tolist() or keys[0] & keys[1]
        for right in (None, sets[len(sets) // 2 :]):  # spanning links give the components of all links
            left = sets if right is None else sets[: len(sets) // 2]
            if left:
                root, other = list(range(len(sets))), list(range(len(sets)))
                for links, r in ((ngram_join.spanning_links(left, right, percent), root), ([p for p in want if right is None or (p[0] < len(left) <= p[1])], other)):
                    for i, j in links:
                        r[:] = [r[i] if x == r[j] else x for x in r]
                assert [root.index(x) for x in root] == [other.index(x) for x in other]


def test_token_counts_and_packing(docs, empty):
    from tokenizers import Tokenizer

    texts = [t or "" for _, t, *_ in corpus()]
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = sorted(str((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids))) for i, t, *_ in corpus())
    got = token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.json")).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_tokens)) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    pieces = packing.pack_documents(docs, vocabulary("word_bpe_49k.json")).collect()
    want = [str((i, a, len(x[a : a + 4096]), zlib.crc32(np.array(x[a : a + 4096], "<u4").tobytes()), len(x))) for (i, *_), x in zip(corpus(), ids) for a in range(0, len(x), 4096)]
    assert sorted(str((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens)) for p in pieces) == sorted(want)
    ends = collections.defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends[p.sequence_id]
        ends[p.sequence_id] += p.length
    assert max(ends.values()) <= 4096
    assert packing.pack_documents(empty, vocabulary("word_bpe_49k.json")).count() == 0


def test_pieces_of_odd_texts():
    from tokenizers import Tokenizer

    from plumeflux.llm.pieces import token_chunks

    rng = random.Random(1)
    parts = ["a", "The", "'s", "'", "’", "é", "É", " ", "  ", "\n", "\u00a0", "\u2003", "\x1c", "12", ".", "—", "<|endoftext|>", "<|", "日", "Σ", "İ", "😀", "e\u0301"]
    texts = [None, ""] + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000)]
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        out = [[] for _ in texts]
        for of, inverse, at, ids, _ in token_chunks(pa.array(texts), vocabulary(name), spaces):
            for o, i in zip(of.tolist(), inverse.tolist()):
                out[o].extend(ids[at[i] : at[i + 1]].tolist())
        assert out == [e.ids for e in Tokenizer.from_file(vocabulary(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_best_fit_decreasing():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 65, 400))[::-1]
    where, offset = packing.best_fit_decreasing(lengths, 64)
    room = {}
    for n, w, at in zip(lengths.tolist(), where.tolist(), offset.tolist()):
        fits = [c for c in room.values() if c >= n]
        assert (room[w] == min(fits)) if w in room else not fits
        assert at == 64 - room.get(w, 64)
        room[w] = room.get(w, 64) - n


def test_mixing(spark, docs, empty):
    got = mixing.mix_sources(docs, rows_per_task=10).collect()
    again = mixing.mix_sources(docs.repartition(5), rows_per_task=10).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(tuple(r)) for r in again)
    sizes = collections.Counter()
    for _, t, _, s, _ in corpus():
        sizes[s] += len(words(t))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        for s in over or list(open_):
            target[s] = 2.0 * sizes[s] if over else weight[s] * level
            left -= target[s] if over else 0
            open_.discard(s)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.taken <= 2 * r.size and r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in names)
    assert mixing.mix_sources(empty).count() == 0


def test_license_scan(spark):
    names = dict(license_scan.LICENSES)
    rows = [(1, f"aa bb {names['MIT']} cc"), (2, "x " * 50 + names["GPL-3.0"]), (3, "released under the mit"), (4, None), (None, names["CC-BY-NC-4.0"].upper()), (5, names["Apache-2.0"] + "\n" + names["MIT"]), (6, "This work is licensed under the GNU General Public License, release 3.")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.LICENSES).collect()
    want = {(1, "MIT", 2), (2, "GPL-3.0", 50), (None, "CC-BY-NC-4.0", 0), (5, "Apache-2.0", 0), (5, "MIT", 7)}
    assert {(r.doc_id, r.license, r.first_word) for r in got} == want


def test_top_k(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(700, 6)).astype(np.float32)
    m[600:] = m[600]
    rows = [(k, [float(v) for v in x]) for k, x in enumerate(m)] + [(1000, None), (1050, [float("nan")] * 6), (1100, [None] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(vectors, F.pmod("vec_id", F.lit(50)) == 0).collect()
    ints = np.floor(256 * m.astype(np.float64))
    want = []
    for q in range(0, 700, 50):
        s = ints @ ints[q]
        order = [int(i) for i in np.lexsort((np.arange(700), -s)) if i != q][:5]
        want += [(q, r + 1, i, int(s[i])) for r, i in enumerate(order)]
    assert sorted(map(tuple, got)) == want


def test_quality(spark, docs, empty):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        good = i % 3 > 0
        w = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) + ("" if good else rng.choice(["!!", "$$$"])) for _ in range(40)]
        rows.append((i, " ".join(w if good else [x.upper() for x in w]), int(good)))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int"))
    got = {r.doc_id: r for r in quality.classify(table.select("doc_id", "text"), labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].predicted == rows[i][2] for i in held]) > 0.95
    assert all(r.score == 0.5 and r.predicted == 1 for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(empty, labels).count() == 0
