"""Band, nearest and interval joins, all planned as equi-joins on derived cells."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeflux.functions.geo import planar_dist2, wrap_lon
from plumeflux.functions.timeconv import HOUR_US, day_index, hour_index, hours_between, micros
from plumeflux.operators.filters import all_of
from plumeflux.operators.scale import broadcast_checked, dealt, spread
from plumeflux.operators.series import with_series
from plumeflux.session import cut_lineage


def cell(value: Column | str, size: float) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / F.lit(float(size))).cast("bigint")


def _offsets(n: int = 1) -> Column:
    return F.explode(F.sequence(F.lit(-n), F.lit(n)))


def box_join(pixels: DataFrame, facilities: DataFrame, buffer_deg: float, cell_deg: float = 1.0) -> DataFrame:
    """Pixels strictly inside the box around each facility, found through shared cells.

    Each facility lists the cells its box touches; only cells that hold pixels count. A table of these under the
    checked size is broadcast, so pixels do not move; with a larger one, cells of many pixels are spread over tasks.
    """
    lat_cells = F.explode(F.sequence(cell(F.col("f_lat") - buffer_deg, cell_deg), cell(F.col("f_lat") + buffer_deg, cell_deg)))
    lon_cells = F.explode(F.sequence(cell(F.col("f_lon") - buffer_deg, cell_deg), cell(F.col("f_lon") + buffer_deg, cell_deg)))
    around_globe = int(360 / cell_deg)
    half = around_globe // 2
    sides = {
        "__s": F.col("f_lat") - buffer_deg,
        "__n": F.col("f_lat") + buffer_deg,
        "__w": wrap_lon(F.col("f_lon") - buffer_deg),
        "__e": wrap_lon(F.col("f_lon") + buffer_deg),
    }
    boxes = (
        facilities.select("facility_id", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
        .withColumn("__cy", lat_cells)
        .withColumn("__cx", lon_cells)
        .withColumn("__cx", F.pmod(F.col("__cx") + half, F.lit(around_globe)) - half)
        .select("facility_id", "__cy", "__cx", *[c.alias(n) for n, c in sides.items()])
        .distinct()
    )
    cells = pixels.withColumns({"__cy": cell("lat", cell_deg), "__cx": cell(wrap_lon("lon"), cell_deg)})
    on = ["__cy", "__cx"]
    boxes, small = broadcast_checked(cut_lineage(boxes.join(cells.select(*on).distinct(), on, "left_semi")))
    if not small:
        cells, boxes = dealt(cells, boxes, on, [c for c in pixels.columns if c not in ("lat", "lon")])
        on.append("__salt")
    east, west = F.col("lon") < F.col("__e"), F.col("lon") > F.col("__w")
    inside = (F.col("lat") > F.col("__s")) & (F.col("lat") < F.col("__n")) & ((west & east) | ((F.col("__w") > F.col("__e")) & (west | east)))
    return cells.join(boxes, on).where(inside).drop("__cy", "__cx", "__salt", *sides)


STRIP = 64


def by_place(facilities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One facility per place (the lowest id), and every ``facility_id`` beside the one that stands for it (``__place``).

    What depends on the place alone is worked out once for all facilities there; ids are unique.
    """
    places = facilities.groupBy("lat", "lon").agg(F.min("facility_id").alias("facility_id"))
    members = facilities.select("facility_id", "lat", "lon").join(places.withColumnRenamed("facility_id", "__place"), ["lat", "lon"])
    return places, cut_lineage(members.select("facility_id", "__place"))


def for_members(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of places (by ``facility_id``) for every facility at the place, columns in the same order."""
    return rows.withColumnRenamed("facility_id", "__place").join(members, "__place").select(*rows.columns)


def in_strips(pixels: DataFrame, granule: str) -> DataFrame:
    """Pixels dealt out by granule and strip of ``STRIP`` scan lines: each meets many boxes, whatever the files' layout."""
    return spread(pixels, granule, F.floor(F.col("i") / F.lit(STRIP)))


def within_radius(
    points: DataFrame, pixels: DataFrame, keys: Sequence[str], radius_deg: float, lat: str, lon: str
) -> DataFrame:
    """Point-pixel pairs of one key closer than ``radius_deg`` (planar degrees), with ``d2``.

    Pixels are copied to their 3x3 cells of the radius' size; points, the larger side, move once.
    """
    near = (
        pixels.withColumns({"__cy": cell("lat", radius_deg), "__cx": cell("lon", radius_deg)})
        .withColumn("__dy", _offsets())
        .withColumn("__dx", _offsets())
        .withColumns({"__cy": F.col("__cy") + F.col("__dy"), "__cx": F.col("__cx") + F.col("__dx")})
        .drop("__dy", "__dx")
    )
    at = points.withColumns({"__cy": cell(lat, radius_deg), "__cx": cell(lon, radius_deg)})
    pairs = at.join(near, [*keys, "__cy", "__cx"]).withColumn("d2", planar_dist2("lat", "lon", lat, lon))
    return pairs.where(F.col("d2") < radius_deg**2).drop("__cy", "__cx")


BRANCH = 8  # cells of a level per cell of the next coarser one, in each direction


def occupied_levels(rows: DataFrame, keys: Sequence[str], cells: Sequence[str], coords: Sequence[str], size: float, extent: float) -> list[DataFrame]:
    """Occupied cells with the bounds of their rows, from cells of ``size`` to cells of at least ``extent``."""
    low = {f"__lo{n}": F.min(x) for n, x in enumerate(coords)}
    high = {f"__hi{n}": F.max(x) for n, x in enumerate(coords)}
    levels = [rows.groupBy(*keys, *cells).agg(*[v.alias(k) for k, v in (low | high).items()])]
    while size < extent:
        size *= BRANCH
        up = [F.floor(F.col(c) / F.lit(BRANCH)).cast("bigint").alias(c) for c in cells]
        bounds = [F.min(k).alias(k) for k in low] + [F.max(k).alias(k) for k in high]
        levels.append(levels[-1].groupBy(*keys, *up).agg(*bounds))
    return levels


def coarse_to_fine(points: DataFrame, levels: Sequence[DataFrame], keys: Sequence[str], ids: Sequence[str], cells: Sequence[str]) -> list[DataFrame]:
    """Per level, from the coarsest: the cells that may hold a point's closest row (points have ``__l0``, ``__l1``, ...).

    A cell stays when its nearest bound is not beyond the farthest bound of some cell of its level. Only
    children of cells that stay are looked at, so a point meets a few cells per level instead of all.
    """

    def square(x: Column) -> Column:
        return x * x

    places = [c for c in points.columns if c.startswith("__l")]
    near, far = [], []
    for n, place in enumerate(places):
        at, a, b = F.col(place), F.col(f"__lo{n}"), F.col(f"__hi{n}")
        near.append(square(F.greatest(a - at, at - b, F.lit(0.0))))
        far.append(square(F.greatest(F.abs(at - a), F.abs(at - b))))
    lowest, highest = (reduce(lambda x, y: x + y, side) for side in (near, far))
    reach = F.min("__max").over(Window.partitionBy(*ids))  # a few cells of one point

    steps: list[DataFrame] = []
    for level in reversed(levels):
        if not steps:
            met = points.join(level, list(keys))
        else:
            parents = [F.floor(F.col(c) / F.lit(BRANCH)).cast("bigint").alias(f"__up_{c}") for c in cells]
            above = steps[-1].select(*ids, *places, *[F.col(c).alias(f"__up_{c}") for c in cells])
            met = above.join(level.select("*", *parents), [*keys, *[f"__up_{c}" for c in cells]])
        bounded = met.withColumns({"__min": lowest, "__max": highest}).withColumn("__u", reach)
        steps.append(bounded.where(F.col("__min") <= F.col("__u")).select(*ids, *places, *cells))
    return steps


def in_reach(points: DataFrame, cells: Sequence[str], size: float) -> DataFrame:
    """Points (``__l0``, ``__l1``, ...) copied to the cells of twice the ``size`` that lie within ``size``: two per coordinate."""
    reach = size * (1.0 + 1e-6)  # rounding of a distance at the limit
    for n, c in enumerate(cells):
        at = F.col(f"__l{n}")
        points = points.withColumn(c, F.explode(F.sequence(cell(at - reach, 2.0 * size), cell(at + reach, 2.0 * size))))
    return points


def nearest_neighbour(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: Sequence[str],
    coords: Sequence[tuple[str, str]],
    tie: Sequence[str],
    carry: Sequence[str],
    size: float,
    extent: float,
) -> DataFrame:
    """For each left row the closest right row of the same key; ties go to the lowest ``tie``.

    ``coords`` pairs left and right coordinate columns of a Euclidean space. Left rows with a
    right row within ``size`` are settled in the cells of twice that size around them. The others go down a
    hierarchy of occupied cells by tight bounds, from cells of about ``extent`` (the usual range of a
    coordinate; more is right but slower) to cells of ``size``, and look only into those that may hold the
    closest row. ``d2`` is null when the key has no right row.
    """
    keys, left_id = list(keys), list(left_id)
    lcols, rcols = [a for a, _ in coords], [b for _, b in coords]
    ids = keys + [c for c in left_id if c not in keys]
    need = list(dict.fromkeys([*keys, *rcols, *tie, *carry]))
    cells = [f"__c{n}" for n in range(len(coords))]
    r = right.select(*need).withColumnsRenamed({x: f"__r_{x}" for x in need if x not in keys})
    placed = r.withColumns({b: cell(f"__r_{x}", 2.0 * size) for b, x in zip(cells, rcols)})
    r = r.withColumns({c: cell(f"__r_{x}", size) for c, x in zip(cells, rcols)})
    me = left.select(*ids, *[F.col(a).alias(f"__l{n}") for n, a in enumerate(lcols)])

    def square(x: Column) -> Column:
        return x * x

    d2 = reduce(lambda a, b: a + b, [square(F.col(f"__l{n}") - F.col(f"__r_{x}")) for n, x in enumerate(rcols)])
    best = F.min_by(
        F.struct(F.col("d2"), *[F.col(f"__r_{c}").alias(c) for c in carry]),
        F.struct("d2", *[F.col(f"__r_{t}") for t in tie]),
    ).alias("__best")

    close = in_reach(me, cells, size).join(placed, keys + cells).withColumn("d2", d2).where(F.col("d2") <= size * size).groupBy(*ids).agg(best)

    far = me.join(close.select(*ids), ids, "left_anti")
    steps = coarse_to_fine(far, occupied_levels(r, keys, cells, [f"__r_{x}" for x in rcols], size, extent), keys, ids, cells)
    maybe = steps[-1].select(*ids, *[f"__l{n}" for n in range(len(coords))], *cells)
    rest = maybe.join(r, keys + cells).withColumn("d2", d2).groupBy(*ids).agg(best)
    found = close.unionByName(rest).select(*ids, "__best.*")
    return left.join(found, ids, "left")


def nearest_pixel(
    points: DataFrame, pixels: DataFrame, keys: Sequence[str], point_id: Sequence[str], lat: str, lon: str, size: float = 0.1
) -> DataFrame:
    """Closest pixel (planar degrees) to each point as ``i``, ``j``; ties go to the lowest index."""
    return nearest_neighbour(points, pixels, keys, point_id, [(lat, "lat"), (lon, "lon")], ["i", "j"], ["i", "j"], size, 360.0)


def unit_vector(df: DataFrame, lat: str, lon: str, prefix: str) -> DataFrame:
    phi, lam = F.radians(lat), F.radians(lon)
    return df.withColumns(
        {f"{prefix}x": F.cos(phi) * F.cos(lam), f"{prefix}y": F.cos(phi) * F.sin(lam), f"{prefix}z": F.sin(phi)}
    )


def nearest_path_row(
    waypoints: DataFrame, traj: DataFrame, keys: Sequence[str], way_id: Sequence[str], carry: Sequence[str], order: str = "step_id"
) -> DataFrame:
    """Great-circle closest path row to each waypoint (by chord length), with its columns."""
    left = unit_vector(waypoints, "lat", "lon", "__w")
    right = unit_vector(traj, "lat", "lon", "__t")
    pairs = [(f"__w{a}", f"__t{a}") for a in "xyz"]
    found = nearest_neighbour(left, right, keys, way_id, pairs, [order], [order, *carry], size=0.002, extent=2.0)
    return found.drop("__wx", "__wy", "__wz", "d2")


def hourly_match(
    rows: DataFrame, hourly: DataFrame, keys: Sequence[str], time: str, hour: str, value: str, tol_hours: float = 0.5
) -> DataFrame:
    """Attach the nearest hourly record within ``tol_hours`` (at most 1, ties to the earlier hour).

    Each hour serves the two hour buckets it can be nearest in, so rows join once by equality.
    """
    if tol_hours > 1.0:
        raise ValueError("use asof_nearest for tolerances above one hour")
    keys = list(keys)
    serve = hourly.select(
        *keys,
        F.struct(micros(hour).alias("t"), F.col(value).alias("v")).alias("__rec"),
        F.explode(F.array(F.struct(F.lit(0).alias("s"), hour_index(hour).alias("b")), F.struct(F.lit(1).alias("s"), (hour_index(hour) - 1).alias("b")))).alias("__at"),
    )
    table = serve.groupBy(*keys, F.col("__at.b").alias("__b")).agg(
        F.max(F.when(F.col("__at.s") == 0, F.col("__rec"))).alias("__lo"),
        F.max(F.when(F.col("__at.s") == 1, F.col("__rec"))).alias("__hi"),
    )
    t = micros(time)
    joined = rows.withColumn("__b", hour_index(time)).join(table, keys + ["__b"], "left")
    d_lo, d_hi = F.abs(t - F.col("__lo.t")), F.abs(F.col("__hi.t") - t)
    use_lo = F.col("__hi").isNull() | (d_lo <= d_hi)
    rec = F.when(use_lo, F.col("__lo")).otherwise(F.col("__hi"))
    gap = F.when(use_lo, d_lo).otherwise(d_hi) / float(HOUR_US)
    ok = gap <= tol_hours
    return joined.withColumns(
        {
            value: F.when(ok, rec["v"]),
            "cems_t_emit": F.when(ok, F.timestamp_micros(rec["t"])),
            "cems_dt_hrs": F.when(ok, gap),
        }
    ).drop("__b", "__lo", "__hi")


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    left_id: str,
    tie: str,
    carry: Sequence[str],
    tol_hours: float | None = None,
) -> DataFrame:
    """Nearest-in-time right row for each left row, any spacing; ties go to the lowest ``tie``.

    Both sides are laid on one time line per key, cut by day, and the rows before and after are
    carried along it; nothing is paired.
    """
    keys = list(keys)
    marks = (
        right.where(F.col(right_time).isNotNull())
        .groupBy(*keys, F.col(right_time).cast("timestamp").alias("__t"))
        .agg(F.min_by(F.struct(F.col(tie).alias("__tie"), *[F.col(c) for c in carry]), F.col(tie)).alias("__p"))
        .withColumn("__p", F.struct("__t", "__p"))
        .withColumns({"__kind": F.lit(0), "__id": F.lit(None).cast(left.schema[left_id].dataType)})
    )
    asks = left.where(F.col(left_time).isNotNull()).select(
        *keys, F.col(left_time).cast("timestamp").alias("__t"), F.col(left_id).alias("__id"), F.lit(1).alias("__kind")
    )
    line = with_series(
        marks.unionByName(asks, allowMissingColumns=True),
        keys,
        ["__t", "__kind", "__id"],
        segment=day_index("__t"),
        ffill={"__lo": "__p"},
        bfill={"__hi": "__p"},
    ).where("__kind = 1")
    t = micros("__t")
    d_lo, d_hi = t - micros(F.col("__lo.__t")), micros(F.col("__hi.__t")) - t
    pick_lo = F.col("__hi").isNull() | (d_lo < d_hi) | ((d_lo == d_hi) & (F.col("__lo.__p.__tie") <= F.col("__hi.__p.__tie")))
    chosen = F.when(F.col("__lo").isNull(), F.col("__hi")).when(pick_lo, F.col("__lo")).otherwise(F.col("__hi"))
    picked = line.select(*keys, F.col("__id").alias(left_id), "__t", chosen.alias("__c")).where(F.col("__c").isNotNull())
    gap = hours_between("__t", F.col("__c.__t"))
    if tol_hours is not None:
        picked = picked.where(F.abs(gap) <= tol_hours)
    out = picked.select(
        *keys, left_id, F.col("__c.__t").alias("matched_time"), gap.alias("dt_hours"), *[F.col(f"__c.__p.{c}").alias(c) for c in carry]
    )
    return left.join(out, [*keys, left_id], "left")


def lookback_join(
    overpass: DataFrame, hourly: DataFrame, keys: Sequence[str], time: str, hour: str, hours: int = 6
) -> DataFrame:
    """Hourly records in [time - hours, time], both ends included."""
    spread = overpass.withColumn("__h", F.explode(F.sequence(hour_index(time) - hours, hour_index(time))))
    joined = spread.join(hourly.withColumn("__h", hour_index(hour)), [*keys, "__h"])
    gap = hours_between(time, hour)
    return joined.where((gap >= 0) & (gap <= hours)).drop("__h")


@dataclass(frozen=True)
class GridSpec:
    """A regular latitude/longitude grid."""

    lat0: float
    dlat: float
    nlat: int
    lon0: float
    dlon: float
    nlon: int

    def indexed(self, grid: DataFrame) -> DataFrame:
        return grid.withColumns(
            {
                "__iy": F.round((F.col("lat") - self.lat0) / self.dlat, 0).cast("int"),
                "__ix": F.round((F.col("lon") - self.lon0) / self.dlon, 0).cast("int"),
            }
        )

    def corners(self, lat: str, lon: str) -> Column:
        """The four corner cells with bilinear weights; edge cells extrapolate linearly."""
        y, x = (F.col(lat) - self.lat0) / self.dlat, (F.col(lon) - self.lon0) / self.dlon
        iy = F.least(F.greatest(F.floor(y), F.lit(0)), F.lit(self.nlat - 2)).cast("int")
        ix = F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(self.nlon - 2)).cast("int")
        fy, fx = y - iy, x - ix
        return F.array(
            *[
                F.struct(
                    (iy + a).alias("iy"),
                    (ix + b).alias("ix"),
                    ((fy if a else 1.0 - fy) * (fx if b else 1.0 - fx)).alias("w"),
                )
                for a in (0, 1)
                for b in (0, 1)
            ]
        )


def grid_interp(
    points: DataFrame,
    grid: DataFrame,
    spec: GridSpec,
    point_id: Sequence[str],
    time: str,
    variables: Sequence[str],
    lat: str = "lat",
    lon: str = "lon",
    also: Sequence[str] = (),
) -> DataFrame:
    """Bilinear values of ``variables`` at each point; null when a corner is missing.

    ``time`` holds the field's valid time for the point (null for none). ``also`` names further
    grid columns to group by, such as the level.
    """
    ids = list(point_id)
    keyed = (
        points.where(all_of([F.col(c).isNotNull() for c in (time, lat, lon)]))
        .select(*ids, F.col(time).alias("valid_time"), F.explode(spec.corners(lat, lon)).alias("__k"))
        .select(*ids, "valid_time", F.col("__k.iy").alias("__iy"), F.col("__k.ix").alias("__ix"), F.col("__k.w").alias("__w"))
    )
    cells = spec.indexed(grid).select("valid_time", "__iy", "__ix", *also, *variables)
    hit = keyed.join(cells, ["valid_time", "__iy", "__ix"])
    values = hit.groupBy(*ids, *also).agg(
        *[F.when(F.count(v) == 4, F.sum(F.col("__w") * F.col(v))).alias(v) for v in variables]
    )
    return points.join(values, ids, "left")


def thickness_mean(levels: DataFrame, ids: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """Mean over levels weighted by absolute pressure thickness."""
    w = F.abs(weight)
    return levels.groupBy(*ids).agg(F.try_divide(F.sum(w * F.col(value)), F.sum(F.when(F.col(value).isNotNull(), w))).alias(out))


def wide_by_trajectory(rows: DataFrame, keys: Sequence[str], values: Sequence[str], order: str = "step_id") -> DataFrame:
    """One row per first-pass step with ``_H`` and ``_O`` columns side by side.

    Step numbers of the two passes count different points; this pairs them by number only.
    """
    ids = [*keys, order]
    first = rows.where("traj = 'H'").select(*ids, *[F.col(v).alias(f"{v}_H") for v in values])
    second = rows.where("traj = 'O'").select(*ids, *[F.col(v).alias(f"{v}_O") for v in values])
    return first.join(second, ids, "left")
