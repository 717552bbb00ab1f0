"""Row filters, flags and projections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeflux.functions.geo import in_box
from plumeflux.operators.scale import exact_quantiles, order_stats, salted_lookup, scalar_join


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def is_number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def is_finite(c: Column) -> Column:
    return is_number(c) & (F.abs(c) < F.lit(float("inf")))


def around(lat: str, lon: str, lat_c, lon_c, buffer_deg: float) -> Column:
    """Strictly inside a box of +-``buffer_deg`` around a centre; safe across the dateline."""
    lat_c = F.lit(lat_c) if not isinstance(lat_c, Column) else lat_c
    lon_c = F.lit(lon_c) if not isinstance(lon_c, Column) else lon_c
    return in_box(lat, lon, lat_c - buffer_deg, lat_c + buffer_deg, lon_c - buffer_deg, lon_c + buffer_deg)


def keep_columns(df: DataFrame, keep: Sequence[str], always: Sequence[str] = ()) -> DataFrame:
    """Project to the listed columns that exist; when none exists keep everything."""
    found = [c for c in keep if c in df.columns]
    if not found:
        return df
    return df.select(*[c for c in always if c in df.columns and c not in found], *found)


def filter_pixels(pixels: DataFrame, qa_min: float = 0.5, value: str = "no2", qa: str = "qa") -> DataFrame:
    v, q = F.col(value), F.col(qa)
    return pixels.where(is_number(v) & (v >= 0.0) & is_number(q) & (q >= qa_min))


def display_pixels(pixels: DataFrame, box: Column, qa_min: float = 0.5, value: str = "no2", qa: str = "qa") -> DataFrame:
    """Pixels fit for display: inside the box, good quality, finite and positive."""
    v, q = F.col(value), F.col(qa)
    return pixels.where(box & is_number(q) & (q >= qa_min) & is_finite(v) & (v > 0))


def second_sensor_pixels(pixels: DataFrame, box: Column, quality_max: float = 0.5, value: str = "no2", quality: str = "quality") -> DataFrame:
    v, q = F.col(value), F.col(quality)
    return pixels.where(box & is_finite(v) & (v > 0) & is_number(q) & (q < quality_max))


def select_overpasses(overpass: DataFrame, start: str, end: str, time: str = "t_start") -> DataFrame:
    """Overpasses from ``start`` to ``end``, both included; pushed down to the scan."""
    return overpass.where(F.col(time).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def usable_pairs(pairs: DataFrame, max_hours: float = 6.0) -> DataFrame:
    return pairs.where("overlap AND n_pts > 0").where(F.abs("dt_min") <= max_hours * 60.0)


def _latitude_bands(extents: DataFrame, facilities: DataFrame, buffer_deg: float, band_deg: float) -> tuple[DataFrame, DataFrame]:
    def bands(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / band_deg), F.floor(hi / band_deg)))

    lo, hi = F.col("lat") - buffer_deg, F.col("lat") + buffer_deg
    boxes = facilities.select("facility_id", lo.alias("__lo"), hi.alias("__hi"), bands(lo, hi).alias("__band"))
    scenes = extents.select("granule_id", "lat_min", "lat_max", bands(F.col("lat_min"), F.col("lat_max")).alias("__band"))
    return scenes, boxes


def prune_granules(extents: DataFrame, facilities: DataFrame, buffer_deg: float, band_deg: float = 1.0) -> DataFrame:
    """(granule, facility) pairs whose latitude ranges touch, found through shared latitude bands."""
    scenes, boxes = _latitude_bands(extents, facilities, buffer_deg, band_deg)
    first_shared = F.greatest(F.floor(F.col("__lo") / band_deg), F.floor(F.col("lat_min") / band_deg))
    return (
        scenes.join(boxes, "__band")
        .where((F.col("__hi") >= F.col("lat_min")) & (F.col("__lo") <= F.col("lat_max")) & (F.col("__band") == first_shared))
        .select("granule_id", "facility_id")
    )


def granules_in_reach(extents: DataFrame, facilities: DataFrame, buffer_deg: float, band_deg: float = 1.0) -> DataFrame:
    """Granules whose latitude range touches any facility's, without forming the pairs."""
    scenes, boxes = _latitude_bands(extents, facilities, buffer_deg, band_deg)
    touch = (scenes["__band"] == boxes["__band"]) & (boxes["__hi"] >= scenes["lat_min"]) & (boxes["__lo"] <= scenes["lat_max"])
    return scenes.join(boxes, touch, "left_semi").select("granule_id").distinct()


def rectangle(i: str = "i", j: str = "j") -> list[Column]:
    """Aggregates for the smallest index rectangle; end indices are exclusive."""
    return [F.min(i).alias("i0"), (F.max(i) + 1).alias("i1"), F.min(j).alias("j0"), (F.max(j) + 1).alias("j1")]


def index_rectangles(hits: DataFrame, keys: Sequence[str], i: str = "i", j: str = "j") -> DataFrame:
    """Smallest index rectangle around the hits of each key; end indices are exclusive."""
    return hits.groupBy(*keys).agg(*rectangle(i, j))


def pixels_in_rectangles(
    pixels: DataFrame, rects: DataFrame, granule: Sequence[str], i: str = "i", j: str = "j", tile: int = 64
) -> DataFrame:
    """Every pixel inside a rectangle (hits or not), joined through index tiles."""

    def tiles(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(lo) / tile), F.floor((F.col(hi) - 1) / tile)))

    spread = rects.withColumn("__ti", tiles("i0", "i1")).withColumn("__tj", tiles("j0", "j1"))
    tiled = pixels.withColumns({"__ti": F.floor(F.col(i) / tile), "__tj": F.floor(F.col(j) / tile)})
    inside = (F.col(i) >= F.col("i0")) & (F.col(i) < F.col("i1")) & (F.col(j) >= F.col("j0")) & (F.col(j) < F.col("j1"))
    return tiled.join(spread, [*granule, "__ti", "__tj"]).where(inside).drop("__ti", "__tj")


def flag_quality(csf: DataFrame, thresholds: Sequence[tuple[str, str, float]], out: str = "qf_gauss_abs") -> DataFrame:
    """0 where every threshold holds, else 1; absent columns and missing values count as bad."""

    def holds(name: str, op: str, limit: float) -> Column:
        if name not in csf.columns:
            return F.lit(False)
        c = F.col(name).cast("double")
        return is_number(c) & ((c >= limit) if op == ">=" else (c <= limit))

    good = all_of([holds(*t) for t in thresholds])
    return csf.withColumn(out, F.when(F.coalesce(good, F.lit(False)), 0).otherwise(1))


def apply_cuts(
    df: DataFrame,
    flag: str,
    cuts: Sequence[tuple[str, float, float]],
    flux_col: str,
    emission: str = "t_emission",
) -> DataFrame:
    """Flag gate, inclusive column cuts (absent columns skipped), positive flux, known emission time."""
    if flux_col not in df.columns:
        raise ValueError(f"flux column {flux_col!r} is missing; has the source-strength step run?")
    out = df.where(F.col(flag) == 0) if flag in df.columns else df
    for name, low, high in cuts:
        if name in df.columns:
            c = F.expr(f"try_cast(`{name}` AS DOUBLE)")
            out = out.where(is_number(c) & c.between(low, high))
    flux = F.expr(f"try_cast(`{flux_col}` AS DOUBLE)")
    out = out.withColumn(flux_col, flux)
    return out.where(is_number(F.col(flux_col)) & (F.col(flux_col) > 0) & F.col(emission).isNotNull())


def age_and_quantile_trim(
    df: DataFrame, age: str, flux: str, age_max: float = 0.2, probs: tuple[float, float] = (0.0, 0.98)
) -> DataFrame:
    """Young rows between two interpolated flux quantiles of the young rows (both included)."""
    young = df.where(F.col(age) < age_max)
    limits = exact_quantiles(young, [], flux, {"__lo": probs[0], "__hi": probs[1]}).drop("n")
    return scalar_join(young, limits).where(F.col(flux).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def flag_absolute(df: DataFrame, rules: Sequence[tuple[str, float, float]], out: str = "qf_abs") -> DataFrame:
    bad = [F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False)) for c, lo, hi in rules if c in df.columns]
    return df.withColumn(out, F.when(reduce(lambda a, b: a | b, bad, F.lit(False)), 1).otherwise(0))


def flag_rank_range(
    df: DataFrame, col: str, vmin: float, vmax: float, keys: Sequence[str] = (), out: str = "qf_pct"
) -> DataFrame:
    """1 for values outside the sorted values at ranks int(n*vmin) and int(n*vmax)-1 of their group."""
    ranks = {
        "__lo": lambda n: F.floor(n * F.lit(float(vmin))),
        "__hi": lambda n: F.pmod(F.floor(n * F.lit(float(vmax))) - 1, n),
    }
    limits = order_stats(df, keys, col, ranks).drop("n")
    joined = salted_lookup(df, limits, keys, [col]) if keys else scalar_join(df, limits)
    bad = (F.col(col) < F.col("__lo")) | (F.col(col) > F.col("__hi"))
    return joined.withColumn(out, F.when(bad, 1).otherwise(0)).drop("__lo", "__hi")


def positive_pairs(df: DataFrame, x: str, y: str, *also_finite: str) -> DataFrame:
    finite = [is_finite(F.col(c)) for c in (x, y, *also_finite)]
    return df.where(all_of(finite) & (F.col(x) > 0) & (F.col(y) > 0))


