"""License scans: MinHash bands over text windows, then exact containment (operator 7), with built-in functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeflux.llm.url_filter import lower_ascii

WIDTH = 5
PERCENT = 80

# One-sentence notices to look for (name, text).
LICENSES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
]
# What may stand around a word without being part of it.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\u00a9\u00ab\u00bb\u2013\u2014\u2018\u2019\u201c\u201d\u2026"


def license_texts() -> list[tuple[str, str]]:
    """Whole licences, file headers and longer notices: (name, text) of every file in the folder ``licenses``. Read by the driver."""
    return [(f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, also where ``body`` uses it in the steps of a loop."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D, A-Z lower-cased, without MARKS at their ends; null counts as empty.

    Words of MARKS only, such as the signs of a comment, do not count.
    """
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+")
    return F.filter(F.transform(parts, lambda w: F.btrim(w, F.lit(MARKS))), lambda w: w != "")


def shingles(w: Column, width: int = WIDTH) -> Column:
    """Hashes of every ``width`` words in a row, in order; fewer words: none."""
    def hashes(own: Column) -> Column:
        n = F.size(own) - width + 1
        each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(own, i, width)))
        return F.when(n >= 1, each).otherwise(F.array().cast("array<bigint>"))

    return let(w, hashes)


def banded(hashes: Column, band: int) -> Column:
    """Shingle hashes under the hash function of a band."""
    return F.transform(hashes, lambda v: F.xxhash64(v, F.lit(band)))


def window_minima(hashes: Column, size: int, step: int, band: int) -> Column:
    """The band's least hash in each window of ``size`` shingles, one window every ``step``."""
    def minima(mixed: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(mixed)), F.lit(step))
        return F.transform(starts, lambda at: F.array_min(F.slice(mixed, at, size)))

    return banded(hashes, band) if size == 1 else let(banded(hashes, band), minima)


def plan(size: int, percent: int = PERCENT, miss: float = 1e-3) -> tuple[int, int]:
    """Step between windows of ``size`` shingles, and bands (of one row) for a chance below ``miss`` to miss a template.

    A passage with ``percent`` of the template's shingles in place is off the nearest window by at most
    half a step, so of the template's ``size`` shingles that window holds all but those and shares a
    Jaccard similarity of at least j with it; each band agrees with chance j.
    """
    step = max(1, size // 4)
    shared = max(1, math.ceil(size * percent / 100) - step // 2)
    j = shared / (2 * size - shared)
    return step, 1 if j >= 1 else math.ceil(math.log(miss) / math.log(1 - j))


def retriever(name: str, t: list[int], least: list[int], percent: int) -> Callable[[Column], Column]:
    """From a text's shingle hashes: the template, where some band of some window agrees with it (``least`` of a band); else null."""
    step, bands = plan(len(t), percent)
    own = F.lit(np.array(t, np.int64))

    def ask(s: Column) -> Column:
        found = F.lit(False)
        for band in range(bands):
            found = found | F.array_contains(window_minima(s, len(t), step, band), F.lit(least[band]))
        # a band agrees only where the template's least shingle occurs, so other texts need no windows
        return F.when(F.arrays_overlap(s, own) & found, F.struct(F.lit(name).alias("name"), own.alias("t")))

    return ask


def scan(docs: DataFrame, templates: list[tuple[str, str]], percent: int = PERCENT, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per match: key, license, shingles_found, shingles_total, first_word (place of its best window).

    A template is found where one window of the text as long as the template (in shingles of ``width``
    words) holds at least ``percent`` / 100 of its distinct shingles; the window with most, then the
    first, is reported. Windows overlap by three quarters. MinHash bands of a window retrieve templates
    of that length; exact containment is then taken over all windows of the text, so bands may miss (with
    a chance below 0.001 a passage) but never add. Templates with fewer than ``width`` words are an
    error. A list of templates is small by its nature (some hundreds) and travels in the plan.
    ``first_word`` counts the words that ``words`` gives, from 0.

    Null or short texts match nothing. Null keys and repeated rows give rows of their own. One scan, no
    shuffle; long texts stay within their row.
    """
    if not templates:
        return docs.limit(0).select(F.col(key), *[F.lit(None).cast(t).alias(c) for c, t in (("license", "string"), ("shingles_found", "int"), ("shingles_total", "int"), ("first_word", "int"))])
    spark = docs.sparkSession
    listed = spark.createDataFrame(templates, "name string, body string").select("name", F.array_distinct(shingles(words(F.col("body")), width)).alias("t"))
    rows = listed.select("name", "t", F.size("t").alias("n")).collect()
    if any(not r["n"] for r in rows):
        raise ValueError("a template has fewer words than a shingle")
    most = max(plan(r["n"], percent)[1] for r in rows)
    least = [r[0] for r in listed.select(F.array(*[F.array_min(banded(F.col("t"), band)) for band in range(most)])).collect()]

    retrieved = [retriever(r["name"], list(r["t"]), mins, percent) for r, mins in zip(rows, least)]
    anything = F.lit(np.unique(np.array([v for r in rows for v in r["t"]], np.int64)))
    # the text's shingles are made once a row, then asked for every template; a filter here would make them again
    def ask_all(s: Column) -> Column:
        # most texts share no shingle with any template
        return F.when(F.arrays_overlap(s, anything), F.filter(F.array(*[r(s) for r in retrieved]), lambda c: c.isNotNull()))

    both = let(shingles(words(F.col(text)), width), lambda s: F.struct(s.alias("s"), ask_all(s).alias("c")))
    candidates = docs.select(F.col(key), both.alias("__b")).select(key, F.col("__b.s").alias("__s"), F.explode("__b.c").alias("c"))
    size = F.size("c.t")

    def best_window(s: Column) -> Column:
        # windows that begin at a shingle of the template decide: some best window is one of them
        starts = F.filter(F.transform(s, lambda v, i: F.when(F.array_contains("c.t", v), i + 1)), lambda i: i.isNotNull())
        counted = F.transform(starts, lambda i: F.struct(F.size(F.array_intersect(F.slice(s, i, size), F.col("c.t"))).alias("found"), (-i).alias("back")))
        return F.array_max(counted)

    best = candidates.select(key, F.col("c.name").alias("license"), let(F.col("__s"), best_window).alias("b"), size.alias("shingles_total"))
    good = best.where(F.col("b.found") * 100 >= F.col("shingles_total") * percent)
    return good.select(key, "license", F.col("b.found").alias("shingles_found"), "shingles_total", (-F.col("b.back") - 1).alias("first_word"))
