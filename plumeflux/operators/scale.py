"""Building blocks for hot keys: salted look-ups, checked broadcasts, exact order statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeflux.session import cut_lineage

# A dimension table is broadcast only when it has at most this many rows.
BROADCAST_MAX_ROWS = 200_000
# A key is salted when it holds more than this many even shares of the rows.
HEAVY = 2
# A value bucket with more rows is cut into SPLIT parts; after so many cuts it holds a handful of doubles.
BUCKET_ROWS = 200_000
SPLIT = 1024
REFINEMENTS = 4


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> tuple[DataFrame, bool]:
    """Hint a broadcast only after counting (at most ``max_rows`` + 1) rows of a dimension table."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small


def heavy_keys(rows: DataFrame, keys: Sequence[str], parts: int) -> dict[int, int]:
    """Salts for keys (by their hash) that hold more than ``HEAVY`` even shares of ``parts`` of the rows.

    Keys are counted in a sketch of frequent items of bounded size, merged map-side, so at most
    ``parts`` / ``HEAVY`` of them come back. A count that is off changes how evenly rows are dealt, never the result.
    """
    tracked = max(1024, min(8 * parts, 1_000_000))
    found = rows.select(F.xxhash64(*keys).alias("__h")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(__h, {parts}, {tracked})").alias("top")).first()
    share = found["n"] / parts
    return {t["item"]: math.ceil(t["count"] / share) for t in found["top"] or () if t["count"] > HEAVY * share}


def dealt(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], like: DataFrame | None = None, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join on ``keys`` with a column ``__salt`` to join on too.

    A key with many rows in ``big`` (or in ``like``, a cheaper table with the same share of rows per
    key) is dealt out by a hash of ``spread``, and its rows of ``small`` are copied as often; others stay as they are.
    """
    parts = parts or int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(big if like is None else like, keys, parts)
    if not heavy:
        zero = F.lit(0)
        return big.withColumn("__salt", zero), small.withColumn("__salt", zero)
    table = F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair])
    salts = F.coalesce(F.try_element_at(table, F.xxhash64(*keys)), F.lit(1))
    salt = F.pmod(F.xxhash64(*spread), salts).cast("int")
    return big.withColumn("__salt", salt), small.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))


def salted_lookup(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    salt_on: Sequence[str] | None = None,
    how: str = "left",
    like: DataFrame | None = None,
) -> DataFrame:
    """Join per-key values onto rows; keys with many rows are spread over tasks by their share of the rows.

    ``small`` has one row per key. No broadcast is forced: the runtime may choose one from
    the measured size of ``small``. ``like`` as in ``dealt``.
    """
    keys = list(keys)
    spread = list(salt_on) if salt_on else [c for c in big.columns if c not in keys]
    rows, copies = dealt(big, small, keys, spread, like)
    return rows.join(copies, keys + ["__salt"], how).drop("__salt")


def spread(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Hash-partition by ``cols`` into the session's shuffle partitions, without later coalescing.

    For few rows that each cause much work (exploded transects, fits, graph searches): adaptive
    coalescing would judge them by their bytes and put them into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def scalar_join(big: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate, computed once as a scalar subquery."""
    row = one_row.select(F.struct(*one_row.columns)).scalar()
    with_row = big.withColumn("__row", row)
    return with_row.select(*big.columns, *[F.col(f"__row.{c}").alias(c) for c in one_row.columns])


def value_bucket(v: Column, per_octave: int = 1024) -> Column:
    """A monotone integer bucket of a double: sign and finely cut logarithm; infinities have buckets of their own."""
    size = F.floor(F.log2(F.when(F.abs(v) == F.lit(float("inf")), F.lit(1.0)).otherwise(F.abs(v))) * F.lit(float(per_octave))) + F.lit(1200 * per_octave)
    endless = F.abs(v) == F.lit(float("inf"))
    size = F.when(endless, F.lit(2400 * per_octave)).otherwise(size)
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * size).cast("bigint")


def order_stats(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    ranks: Mapping[str, Callable[[Column], Column]],
    task_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Exact order statistics per key without gathering a key's values in one task.

    ``ranks`` maps an output name to a function of the group size returning a 0-based rank.
    A histogram over value buckets (combined map-side) finds the bucket of each rank. While the rows of
    a found bucket are more than ``task_rows``, it is cut evenly between its lowest and highest value
    and the rank's place in it is found the same way. Only rows of the last buckets are ranked by
    value, so no task orders more than about ``task_rows`` different values. Adds ``n``, the count of non-null values.
    """
    keys = list(keys)
    v = F.col(col).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("__v"), value_bucket(v).alias("__b"))
    counted = [F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")]
    hist = rows.groupBy(*keys, "__b").agg(*counted)

    everything = [F.lit(1)] if not keys else [F.col(k) for k in keys]
    by_key = Window.partitionBy(*everything)
    cumulative = by_key.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.select("*", F.sum("__n").over(cumulative).alias("__cum"), F.sum("__n").over(by_key).alias("n"))
    start = F.col("__cum") - F.col("__n")
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("__name"), (fn(F.col("n")).cast("bigint") - start).alias("__off"))
            for name, fn in ranks.items()
        ]
    )
    inside = F.filter(wanted, lambda s: (s["__off"] >= 0) & (s["__off"] < F.col("__n")))
    bucket = ["__b", "__n", "__lo", "__hi"]
    targets = cut_lineage(ranked.select(*keys, *bucket, "n", F.explode(inside).alias("__t")).select(*keys, *bucket, "n", "__t.*"))

    for _ in range(REFINEMENTS):
        large = (F.col("__n") > task_rows) & (F.col("__lo") < F.col("__hi"))
        if targets.where(large).isEmpty():
            break
        part = F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * F.lit(float(SPLIT - 1))).cast("bigint")
        finer = (F.col("__b") * SPLIT + F.when(large, part).otherwise(0)).alias("__b")
        rows = cut_lineage(rows.join(targets.select(*keys, *bucket).distinct(), keys + ["__b"]).select(*keys, "__v", F.col("__b").alias("__old"), finer))
        hist = rows.groupBy(*keys, "__old", "__b").agg(*counted)
        within = Window.partitionBy(*everything, "__old").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("__start", F.sum("__n").over(within) - F.col("__n"))
        asked = targets.select(*keys, F.col("__b").alias("__old"), "n", "__name", "__off")
        met = hist.join(asked, keys + ["__old"]).withColumn("__off", F.col("__off") - F.col("__start"))
        targets = cut_lineage(met.where((F.col("__off") >= 0) & (F.col("__off") < F.col("__n"))).select(*keys, *bucket, "n", "__name", "__off"))
        rows = rows.drop("__old")

    buckets = targets.select(*keys, "__b").distinct()
    targets = targets.select(*keys, "__b", "n", "__name", "__off")
    hits = rows.join(buckets, keys + ["__b"], "left_semi").groupBy(*keys, "__b", "__v").agg(
        F.count(F.lit(1)).alias("__m")
    )
    in_bucket = Window.partitionBy(*everything, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("__hi", F.sum("__m").over(in_bucket))
    picked = hits.join(targets, keys + ["__b"]).where(
        (F.col("__off") >= F.col("__hi") - F.col("__m")) & (F.col("__off") < F.col("__hi"))
    )
    grouped = picked.groupBy(*keys) if keys else picked.groupBy()
    return grouped.agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in ranks],
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], col: str, probs: Mapping[str, float], bounded: bool = False
) -> DataFrame:
    """Linearly interpolated quantiles per key, one output column per entry of ``probs``.

    ``bounded=True`` uses the built-in aggregate and is for groups of known small size.
    """
    keys = list(keys)
    if bounded:
        v = F.col(col).cast("double")
        clean = df.where(v.isNotNull() & ~F.isnan(v))
        return clean.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), *[F.percentile(v, F.lit(p)).alias(o) for o, p in probs.items()]
        )
    ranks: dict[str, Callable[[Column], Column]] = {}
    for out, p in probs.items():
        ranks[f"__lo_{out}"] = lambda n, p=p: F.floor(F.lit(float(p)) * (n - 1))
        ranks[f"__hi_{out}"] = lambda n, p=p: F.ceil(F.lit(float(p)) * (n - 1))
    stats = order_stats(df, keys, col, ranks)

    def interpolate(out: str, p: float) -> Column:
        at = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"__lo_{out}"), F.col(f"__hi_{out}")
        return (lo + (hi - lo) * (at - F.floor(at))).alias(out)

    return stats.select(*keys, "n", *[interpolate(o, p) for o, p in probs.items()])


def median_mad(df: DataFrame, keys: Sequence[str], col: str, bounded: bool = False) -> DataFrame:
    """Per key: count, median and median absolute deviation of ``col``."""
    keys = list(keys)
    med = exact_quantiles(df, keys, col, {"median": 0.5}, bounded)
    rows = df.select(*keys, F.col(col).cast("double").alias("__x"))
    with_med = salted_lookup(rows, med, keys, ["__x"]) if keys else scalar_join(rows, med)
    dev = with_med.withColumn("__dev", F.abs(F.col("__x") - F.col("median")))
    mad = exact_quantiles(dev, keys, "__dev", {"mad": 0.5}, bounded).drop("n")
    return med.join(mad, keys) if keys else scalar_join(med, mad)
