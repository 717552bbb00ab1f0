"""URL filters: a blocked Bloom filter before an exact join with the listed URLs (operator 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeflux.llm.bloom import FILTER_BYTES, WORDS, block_of, bloom_blocks, may_hold, n_blocks

_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)


def _candidates(lengths: list[int], labels: int) -> Column:
    """Canonical URLs that a rule for this url would have: each parent host of at most ``labels`` labels with each listed path length."""
    last = lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k)
    dots = F.char_length("host") - F.char_length(F.replace("host", F.lit("."), F.lit("")))
    hosts = F.transform(F.sequence(F.lit(1), F.least(dots + 1, F.lit(labels))), last)
    paths = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("path", 1, n).alias("p")) for n in lengths]), lambda s: F.char_length(s["p"]) == s["n"])
    return F.flatten(F.transform(hosts, lambda a: F.transform(paths, lambda s: F.struct(a.alias("host"), s["p"].alias("path")))))


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Per row of ``pages``: key, host, path, rule and verdict.

    ``rules`` has host (lower case), path and verdict, one row a pair. A rule fits its host and all
    subdomains when the url's path starts with the rule's; the longest (host and path together, then
    the longer host) wins. Without a rule, ``rule`` is null and the verdict is ``default``: the list
    names exceptions, so an unlisted URL stays.

    Candidates of a url (parent hosts x listed path lengths) pass a blocked Bloom filter; the few that
    pass meet the list in an exact hash join, which removes false positives, once for each distinct
    url. A filter of at most ``filter_bytes`` is a scalar in the scan; a larger one is joined by
    block. Only key and url are read. Hosts are taken from their end, up to as many labels as the longest
    listed host has, so a very long host makes few candidates. Null urls and urls without ``://`` have empty host and path and
    meet only rules of an empty host; null keys and repeated rows keep their rows; no rules or no pages
    are fine.
    """
    facts = rules.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.char_length("path"))).alias("lengths"), F.max(F.size(F.split("host", r"\.", -1))).alias("labels")).first()
    rows = pages.select(F.col(key), F.col(url).alias("__url"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    if not facts["n"]:
        return rows.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = n_blocks(facts["n"])
    filters = bloom_blocks(rules, F.xxhash64("host", "path"), blocks)
    urls = rows.select("host", "path").distinct().withColumn("__c", _candidates(facts["lengths"], facts["labels"]))
    hashed = lambda c: F.xxhash64(c["host"], c["path"])
    if blocks * WORDS * 8 <= filter_bytes:
        held = filters.agg(F.array_sort(F.collect_list(F.struct("block", "words")))["words"].alias("m")).scalar()
        urls = urls.withColumn("__m", held)
        passed = F.filter("__c", lambda c: may_hold(F.col("__m")[block_of(hashed(c), blocks)], hashed(c)))
        hits = urls.select("host", "path", F.explode(passed).alias("__c"))
    else:
        hits = urls.select("host", "path", F.explode("__c").alias("__c")).withColumn("block", block_of(hashed(F.col("__c")), blocks))
        hits = hits.join(filters, "block").where(may_hold(F.col("words"), hashed(F.col("__c"))))
    listed = rules.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("verdict").alias("__v"))
    exact = hits.join(listed, (F.col("__c.host") == F.col("__h")) & (F.col("__c.path") == F.col("__p")))
    rank = F.struct((F.char_length("__h") + F.char_length("__p")).alias("n"), F.char_length("__h").alias("m"))
    best = exact.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("__h", "__p").alias("rule"), "__v"), rank).alias("__b"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(key, "host", "path", F.col("__b.rule").alias("rule"), F.coalesce("__b.__v", F.lit(default)).alias("verdict"))
