"""Grouped summaries; all combine partially before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeflux.config import LB_TO_TONNE
from plumeflux.functions.timeconv import hours_between
from plumeflux.operators.filters import is_number
from plumeflux.operators.scale import exact_quantiles, median_mad, order_stats, salted_lookup


def clip_stats(clipped: DataFrame, keys: Sequence[str], value: str = "no2", time: str = "t_utc") -> DataFrame:
    """One overpass-index row per key: valid count, time and coordinate range, index rectangle."""
    return clipped.groupBy(*keys).agg(
        F.count(F.when(is_number(F.col(value)), 1)).alias("n_data"),
        F.min(time).alias("time_utc_i"),
        F.max(time).alias("time_utc_f"),
        F.min("lat").alias("latmin"),
        F.max("lat").alias("latmax"),
        F.min("lon").alias("lonmin"),
        F.max("lon").alias("lonmax"),
        F.min("i").alias("scanline_i0"),
        (F.max("i") + 1).alias("scanline_i1"),
        F.min("j").alias("pixel_j0"),
        (F.max("j") + 1).alias("pixel_j1"),
    )


def hourly_totals(cems: DataFrame, keys: Sequence[str], hour: str, mass: str, out: str = "cems_nox_tph") -> DataFrame:
    """Sum over units per known hour, pounds to tonnes; an hour of only missing masses is 0."""
    return (
        cems.where(F.col(hour).isNotNull())
        .groupBy(*keys, hour)
        .agg((F.coalesce(F.sum(F.expr(f"try_cast(`{mass}` AS DOUBLE)")), F.lit(0.0)) * LB_TO_TONNE).alias(out))
    )


def mean_and_std(df: DataFrame, keys: Sequence[str], col: str, mean: str, std: str | None = None) -> DataFrame:
    aggs = [F.avg(col).alias(mean)] + ([F.stddev_samp(col).alias(std)] if std else [])
    return df.groupBy(*keys).agg(*aggs)


def circular_std(df: DataFrame, keys: Sequence[str], bearing: str, out: str = "wd_std") -> DataFrame:
    rad = F.radians(bearing)
    r = F.sqrt(F.pow(F.avg(F.sin(rad)), F.lit(2)) + F.pow(F.avg(F.cos(rad)), F.lit(2)))
    return df.groupBy(*keys).agg(F.degrees(F.sqrt(-2.0 * F.log(F.least(r, F.lit(1.0))))).alias(out))


def wind_std(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.stddev_samp("u").alias("u_std"), F.stddev_samp("v").alias("v_std"))


def scene_background(pixels: DataFrame, keys: Sequence[str], value: str = "no2", low_quartile: bool = False) -> DataFrame:
    """Background level (median, or first quartile) and inter-quartile range per scene."""
    q = exact_quantiles(pixels, keys, value, {"__q25": 0.25, "__q50": 0.5, "__q75": 0.75})
    level = F.col("__q25") if low_quartile else F.col("__q50")
    return q.select(*keys, level.alias("bg"), (F.col("__q75") - F.col("__q25")).alias("bg_iqr"))


def mad_outliers(df: DataFrame, keys: Sequence[str], col: str, k: float) -> DataFrame:
    """Adds ``is_far`` (value > median + k*MAD) and ``is_near`` (|value| <= k*(MAD + 1e-9))."""
    spread = median_mad(df, keys, col).select(*keys, "median", "mad")
    v = F.col(col)
    return salted_lookup(df, spread, keys, [col]).withColumns(
        {"is_far": v > F.col("median") + k * F.col("mad"), "is_near": F.abs(v) <= k * (F.col("mad") + 1e-9)}
    )


def regression(pairs: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    """Slope, intercept, r and n per key; fits need at least ``min_n`` pairs."""
    enough = F.count(F.lit(1)) >= min_n

    spread = F.stddev_pop(x) * F.stddev_pop(y)

    def fit(c: Column) -> Column:
        return F.when(enough, c)

    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        fit(F.regr_slope(y, x)).alias("slope"),
        fit(F.regr_intercept(y, x)).alias("intercept"),
        fit(F.try_divide(F.covar_pop(y, x), F.nullif(spread, F.lit(0.0)))).alias("r"),
    )


def latest_per_key(rows: DataFrame, key: str, order: Sequence[str], rename: dict[str, str] | None = None) -> DataFrame:
    """The row with the greatest ``order`` per key, with columns renamed."""
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(key, "__r.*")
    return last.withColumnsRenamed(rename or {})


def binned(df: DataFrame, col: str, bins: Sequence[tuple[float, float]]) -> DataFrame:
    """Attach half-open bins [t0, t1); a row falls in every bin that holds it."""
    edges = F.array(*[F.struct(F.lit(float(a)).alias("t0"), F.lit(float(b)).alias("t1")) for a, b in bins])
    v = F.col(col)
    held = F.filter(edges, lambda e: (v >= e["t0"]) & (v < e["t1"]))
    return df.withColumn("__bin", F.explode(held)).select("*", "__bin.t0", "__bin.t1").drop("__bin")


def youngest_values(df: DataFrame, keys: Sequence[str], age: str, cols: dict[str, str], tie: str) -> DataFrame:
    """Per key the non-null value at least |age| for each column, and the least age in minutes."""
    picks = [
        F.min_by(src, F.when(is_number(F.col(src)), F.struct(F.abs(age), F.col(tie)))).alias(out)
        for out, src in cols.items()
    ]
    return df.groupBy(*keys).agg(*picks, (F.min(F.abs(age)) * 60.0).alias("transport_min"))


def ingest_report(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("overlap")).alias("overlap"),
        F.count_if(~F.col("overlap")).alias("no_overlap"),
        F.count_if(F.col("status") != "ok").alias("errors"),
    )


def rank_limits(df: DataFrame, keys: Sequence[str], col: str, p_lo: float, p_hi: float) -> DataFrame:
    """Nearest-rank limits: sorted values at index int(n*p)."""
    return order_stats(
        df,
        keys,
        col,
        {"vmin": lambda n: F.floor(n * F.lit(float(p_lo))), "vmax": lambda n: F.floor(n * F.lit(float(p_hi)))},
    )


def quantile_limits(df: DataFrame, keys: Sequence[str], col: str, p_lo: float = 0.02, p_hi: float = 0.98) -> DataFrame:
    return exact_quantiles(df, keys, col, {"vmin": p_lo, "vmax": p_hi})


def at_least(df: DataFrame, keys: Sequence[str], min_n: int = 3) -> DataFrame:
    """Rows of groups with at least ``min_n`` rows."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_n).drop("__n")
    return salted_lookup(df, big, keys, how="left_semi")


def scene_wind(traj: DataFrame, keys: Sequence[str], wind: str = "wso", missing: float = -9999.0) -> DataFrame:
    w = F.when(F.col(wind) != missing, F.col(wind))
    return traj.groupBy(*keys).agg(F.avg(w).alias("wso_mean"), F.stddev_samp(w).alias("wso_std"))


def window_summary(hours: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Each record with its hours before the last record of its window, and the window mean."""
    ends = hours.groupBy(*keys).agg(F.max(time).alias("__end"), F.avg(value).alias("window_mean"))
    joined = salted_lookup(hours, ends, keys, [time])
    return joined.withColumn("transport_hrs", hours_between("__end", time)).drop("__end")


def pair_statistics(pixels: DataFrame, pair: str, sensor: str, value: str) -> DataFrame:
    """Counts and range per pair and sensor, plus the 2-98 % range shared by both sensors."""
    each = pixels.groupBy(pair, sensor).agg(
        F.count(F.lit(1)).alias("n_pix"), F.min(value).alias("v_min"), F.max(value).alias("v_max")
    )
    shared = quantile_limits(pixels, [pair], value).select(pair, "vmin", "vmax")
    return each.join(shared, pair)
