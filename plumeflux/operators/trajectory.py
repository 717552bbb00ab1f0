"""Series operators on trajectories and paths (ordered by step within their keys)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeflux.functions.geo import bearing_deg, haversine_m, wrap180
from plumeflux.functions.timeconv import from_micros, micros
from plumeflux.operators.scale import median_mad, salted_lookup
from plumeflux.operators.series import SEG, halo_segments, step_segment, with_series
from plumeflux.session import cut_lineage


def _neighbours(df: DataFrame, keys: Sequence[str], order: str, halo: int = 1) -> tuple[DataFrame, Window]:
    part = halo_segments(df, order, halo=halo)
    return part, Window.partitionBy(*keys, SEG).orderBy(order)


def _core(df: DataFrame) -> DataFrame:
    return df.where("__core").drop(SEG, "__core")


def step_distance(traj: DataFrame, keys: Sequence[str], order: str = "step_id") -> DataFrame:
    """Adds ``step_m``, the distance from the previous point (0 at the start)."""
    near, w = _neighbours(traj, keys, order)
    step = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    return _core(near.withColumn("step_m", F.coalesce(step, F.lit(0.0))))


def cumulative_distance(traj: DataFrame, keys: Sequence[str], order: str = "step_id") -> DataFrame:
    """Adds ``step_m`` and ``age_km``, the distance travelled since the first point."""
    path = with_series(
        step_distance(traj, keys, order), keys, [order], segment=step_segment(order), running={"__m": "step_m"}
    )
    return path.withColumn("age_km", F.col("__m") / 1000.0).drop("__m")


def with_kinematics(
    traj: DataFrame,
    keys: Sequence[str],
    t_overpass: str | None = "t_overpass",
    order: str = "step_id",
    last_row: str = "null",
    dt_steps: tuple[int, int] = (1, 2),
    zero_dt: str = "null",
) -> DataFrame:
    """All derived columns of a path with steps 0, 1, 2, ...

    ``age_km`` distance travelled; ``wd`` bearing from the first point (the first row repeats
    the second); ``wso``, ``u``, ``v`` speed to the next point over one path-wide time step
    taken between rows ``dt_steps`` (last row null, or ``last_row='repeat'``); ``time_tag`` the
    overpass time moved back by the time since the first point. Without time between those rows
    speeds are null, or with ``zero_dt='ieee'`` infinite (NaN where nothing moved).
    """
    near, w = _neighbours(traj, keys, order, halo=2)
    nlat, nlon = F.lead("lat").over(w), F.lead("lon").over(w)
    legs = {
        "wso": haversine_m("lat", "lon", nlat, nlon),
        "u": haversine_m("lat", "lon", "lat", nlon),
        "v": haversine_m("lat", nlon, nlat, nlon),
    }
    here = near.withColumns(legs)
    if last_row == "repeat":
        here = here.withColumns({k: F.coalesce(k, F.lag(k).over(w)) for k in legs})
    step = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    timed = {f"__t{n}": F.when(F.col(order) == s, micros("tstmp")) for n, s in enumerate(dt_steps)}
    here = here.withColumns(
        {"__step": F.coalesce(step, F.lit(0.0)), "__wd0": bearing_deg("lat", "lon", nlat, nlon), **timed}
    )
    full = with_series(
        _core(here),
        keys,
        [order],
        segment=step_segment(order),
        running={"__m": "__step"},
        first={"__lat0": "lat", "__lon0": "lon", "__tf": "tstmp"},
        overall={"__ta": "__t0", "__tb": "__t1"},
    )
    dt = F.floor((F.col("__tb") - F.col("__ta")) / F.lit(1_000_000))

    def speed(leg: str) -> Column:
        moving = F.when(dt > 0, F.col(leg) / dt)
        if zero_dt == "null":
            return moving
        at_once = F.when(F.col(leg) > 0, F.lit(float("inf"))).when(F.col(leg) == 0, F.lit(float("nan")))
        return F.when(dt == 0, at_once).otherwise(moving)

    wd = F.when(F.col(order) == 0, F.col("__wd0")).otherwise(bearing_deg("__lat0", "__lon0", "lat", "lon"))
    out = {"age_km": F.col("__m") / 1000.0, "wd": wd, **{k: speed(k) for k in legs}}
    if t_overpass:
        out["time_tag"] = from_micros(micros(t_overpass) - (micros("tstmp") - micros("__tf")))
    kept = [c for c in traj.columns if c not in out]
    return full.select(*kept, *[c.alias(n) for n, c in out.items()])


def segments(traj: DataFrame, keys: Sequence[str], order: str = "step_id") -> DataFrame:
    """One row per leg: midpoint, leg bearing and the bearing across it."""
    near, w = _neighbours(traj, keys, order)
    near = _core(near.withColumns({"__nlat": F.lead("lat").over(w), "__nlon": F.lead("lon").over(w)}))
    along = bearing_deg("lat", "lon", "__nlat", "__nlon")
    return near.where(F.col("__nlat").isNotNull()).select(
        *keys,
        order,
        ((F.col("lat") + F.col("__nlat")) / 2).alias("lat_mid"),
        ((F.col("lon") + F.col("__nlon")) / 2).alias("lon_mid"),
        along.alias("seg_bearing"),
        F.pmod(along + 90.0, F.lit(360.0)).alias("perp_bearing"),
    )


def direction_difference(rows: DataFrame, keys: Sequence[str], order: str = "step_id") -> DataFrame:
    """Adds ``wd_diff``: fitted-centre direction minus path direction, both from the first row."""
    near = with_series(
        rows,
        keys,
        [order],
        segment=step_segment(order),
        row_number="__i",
        first={f"__f_{c}": c for c in ("lat_a3", "lon_a3", "lat_tdump", "lon_tdump")},
        lead={f"__n_{c}": c for c in ("lat_a3", "lon_a3", "lat_tdump", "lon_tdump")},
    )

    def turn(prefix: str) -> Column:
        def c(name: str) -> Column:
            return F.col(f"{prefix}{name}")

        fitted = bearing_deg("__f_lat_a3", "__f_lon_a3", c("lat_a3"), c("lon_a3"))
        path = bearing_deg("__f_lat_tdump", "__f_lon_tdump", c("lat_tdump"), c("lon_tdump"))
        return wrap180(fitted - path)

    diff = F.when(F.col("__i") == 1, turn("__n_")).otherwise(turn(""))
    return near.withColumn("wd_diff", diff).select(*rows.columns, "wd_diff")


def flag_path_outliers(
    points: DataFrame,
    keys: Sequence[str],
    order: str = "step_id",
    turn_deg: float = 45.0,
    mad_k: float = 3.0,
    bounded: bool = False,
) -> DataFrame:
    """Adds ``inlier``: false for jump-and-return points and for overlong incoming steps.

    ``order`` must be dense (see ``reindex``). The first point of a path is never rejected, so
    no path loses all its points; paths of fewer than three points keep every point. The
    step distances are materialised once because median and deviation need several passes.
    ``bounded=True`` is for paths of one trajectory's length (a few dozen points).
    """
    near, w = _neighbours(points, keys, order, halo=2)
    plat, plon = F.lag("lat").over(w), F.lag("lon").over(w)
    nlat, nlon = F.lead("lat").over(w), F.lead("lon").over(w)
    turn = wrap180(bearing_deg("lat", "lon", nlat, nlon) - bearing_deg(plat, plon, "lat", "lon"))
    near = near.withColumns({"__turn": turn, "__step": haversine_m(plat, plon, "lat", "lon")})
    near = cut_lineage(_core(near.withColumn("__turn_next", F.lead("__turn").over(w))))
    spread = median_mad(near, keys, "__step", bounded).select(*keys, "median", "mad")
    joined = salted_lookup(near, spread, keys, [order])
    sharp = F.abs("__turn") > turn_deg
    returns = (F.abs("__turn_next") > turn_deg) & (F.signum("__turn") != F.signum("__turn_next"))
    spike = F.when(F.col("__turn_next").isNotNull(), sharp & returns).otherwise(sharp)
    far = F.col("__step") > F.col("median") + mad_k * F.col("mad")
    bad = F.coalesce(spike, F.lit(False)) | F.coalesce(far, F.lit(False))
    return joined.withColumn("inlier", ~bad).select(*points.columns, "inlier")


def reindex(rows: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column | None, out: str = "idx") -> DataFrame:
    """Adds a dense 0-based position along ``order``."""
    ranked = with_series(rows, keys, list(order), segment=segment, row_number=out)
    return ranked.withColumn(out, F.col(out) - 1)


def drop_repeats(rows: DataFrame, keys: Sequence[str], value: str, order: str = "step_id") -> DataFrame:
    """Keep the first row (by ``order``) for every value of ``value``."""
    by = list(keys) + [value]
    rest = [c for c in rows.columns if c not in by]
    return (
        rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r")).select(*by, "__r.*").select(*rows.columns)
    )


def piecewise_lookup(
    queries: DataFrame, nodes: DataFrame, keys: Sequence[str], at: str, x: str, y: str, out: str, segment_width: float | None = None
) -> DataFrame:
    """Piecewise-linear ``y(x)`` from ``nodes`` at ``queries[at]``, clamped at both ends.

    ``segment_width`` cuts long series by ``x`` so that a hot key is not one task.
    """
    keys = list(keys)
    node = nodes.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("__x")).agg(
        F.min(y).alias("__y")
    )
    node = node.select(*keys, "__x", F.struct("__x", "__y").alias("__node"), F.lit(0).alias("__kind"))
    ask = queries.select(*keys, F.col(at).alias("__x"), F.struct(*queries.columns).alias("__q"), F.lit(1).alias("__kind"))
    both = node.unionByName(ask, allowMissingColumns=True)
    if segment_width:
        seg = F.floor(F.col("__x") / segment_width)
        both = both.withColumn("__id", F.when(F.col("__kind") == 1, F.xxhash64("__q")))
        line = with_series(
            both, keys, ["__x", "__kind", "__id"], segment=seg, ffill={"__lo": "__node"}, bfill={"__hi": "__node"}
        )
    else:
        line = with_series(both, keys, ["__x", "__kind"], ffill={"__lo": "__node"}, bfill={"__hi": "__node"})
    lo, hi = F.col("__lo"), F.col("__hi")
    share = (F.col("__x") - lo["__x"]) / (hi["__x"] - lo["__x"])
    between = lo["__y"] + (hi["__y"] - lo["__y"]) * share
    value = F.when(lo.isNull(), hi["__y"]).when(hi.isNull() | (hi["__x"] == lo["__x"]), lo["__y"]).otherwise(between)
    return line.where("__kind = 1").select("__q.*", value.alias(out))


def derive_corners(pixels: DataFrame, keys: Sequence[str], i: str = "i", j: str = "j") -> DataFrame:
    """Four corners per pixel as midpoints between neighbouring centres, edges extrapolated.

    Corner order: (i, j), (i, j+1), (i+1, j+1), (i+1, j) of the corner grid.
    """

    def edges(df: DataFrame, part: list[str], order: str, cols: dict[str, str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(order)
        out = {}
        for name, c in cols.items():
            cur, prev, nxt = F.col(c), F.lag(c).over(w), F.lead(c).over(w)
            out[f"{name}_lo"] = F.coalesce((prev + cur) / 2, cur - ((cur + nxt) / 2 - cur))
            out[f"{name}_hi"] = F.coalesce((cur + nxt) / 2, cur + (cur - (prev + cur) / 2))
        return df.withColumns(out)

    keys = list(keys)
    rows = edges(pixels, [*keys, j], i, {"__lat": "lat", "__lon": "lon"})
    mid = {f"__{c}_{e}": f"__{c}_{e}" for c in ("lat", "lon") for e in ("lo", "hi")}
    grid = edges(rows, [*keys, i], j, mid)

    def ring(c: str) -> Column:
        return F.array(f"__{c}_lo_lo", f"__{c}_lo_hi", f"__{c}_hi_hi", f"__{c}_hi_lo")

    return grid.select(*pixels.columns, ring("lat").alias("lat_bounds"), ring("lon").alias("lon_bounds"))
