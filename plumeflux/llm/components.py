"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeflux.session import cut_lineage

EDGES_PER_FILE = 50_000


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for every node of ``edges`` (columns a, b; any comparable type).

    Alternates large-star and small-star steps: neighbours move to the smallest node known, until the
    edges form stars; that takes about the logarithm of the longest path. Each step aggregates a minimum
    per node (combined before the shuffle) and joins it back, and each round is written to the shared
    folder, in files of about ``EDGES_PER_FILE`` edges: a file of a local folder costs its executor a
    process (chmod), so many small ones are dear. More than ``rounds`` rounds raise an error rather than give a partial result.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def fingerprint(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    mark = fingerprint(now)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        # large star: neighbours above a node point to the least node around it
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its neighbours below point to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        files = -(-mark[0] // EDGES_PER_FILE)  # by the edges of the round before
        now = cut_lineage(small.select("e.a", "e.b").where("a <> b").distinct().coalesce(files))
        after = fingerprint(now)
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
