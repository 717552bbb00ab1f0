"""Whole licences and notices inside other text, against brute force over all windows."""

import random

from plumeflux.llm import license_scan


def words(text):
    cut = [w.strip(license_scan.MARKS) for w in text.lower().split()]
    return [w for w in cut if w]


def shingles(w):
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


def brute(text, template):
    s, t = shingles(words(text)), set(shingles(words(template)))
    best = max(((len(set(s[k : k + len(t)]) & t), -k) for k in range(len(s))), default=(0, 0))
    return (best[0], len(t), -best[1]) if best[0] * 100 >= 80 * len(t) else None


def test_real_licences(spark):
    listed = [x for x in license_scan.LICENSES + license_scan.license_texts() if len(x[1]) < 3000]
    texts, rng = dict(listed), random.Random(5)
    noise = lambda n: " ".join(f"n{rng.randrange(999)}" for _ in range(n))
    changed = texts["MIT-text"].replace("Software", "Program", 2).replace("AUTHORS OR ", "")
    other = texts["BSD-3-Clause-text"].replace(" the ", " a ")
    comment = "\n".join(f" * {x}" for x in texts["GPL-3.0-header"].split("\n"))
    rows = [noise(70) + f"\n{texts[n]}\n" + noise(9) for n in ("MIT-text", "Apache-2.0-header", "BSD-3-Clause-text", "CC-BY-4.0-notice")]
    rows += [changed, other, f"/*\n{comment}\n */ int main", "Released under the MIT License,", "see: released under the MIT License"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.shingles_found, r.shingles_total, r.first_word) for r in license_scan.scan(docs, listed).collect()}
    want = {(k, n): b for k, x in enumerate(rows) for n, t in listed if (b := brute(x, t))}
    assert got == want
    assert {(0, "MIT-text"), (1, "Apache-2.0"), (1, "Apache-2.0-header"), (4, "MIT-text"), (6, "GPL-3.0-header"), (7, "MIT"), (8, "MIT")} <= set(got)


def test_registered(spark, tmp_path):
    from plumeflux.llm.queries import QUERIES

    whole = dict(license_scan.license_texts())["Apache-2.0-text"]
    spark.createDataFrame([(1, whole), (None, "nothing")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op7_license_scan"](spark, str(tmp_path)).collect()
    assert (1, "Apache-2.0-text") in {(r.doc_id, r.license) for r in got}
