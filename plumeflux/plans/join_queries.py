"""Registered queries for joins and transect sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeflux.config import FluxConfig
from plumeflux.fixtures import GRID_LAT0, GRID_LON0, GRID_NLAT, GRID_NLON, Inputs
from plumeflux.functions import timeconv as T
from plumeflux.functions.geo import destination
from plumeflux.operators import aggregates as ag
from plumeflux.operators import joins as jn
from plumeflux.operators import sampling as sm
from plumeflux.operators.filters import filter_pixels
from plumeflux.plans.registry import query
from plumeflux.plans.series_queries import NEAR, W, bear, hav

CFG = FluxConfig()
KEY = ["facility_id"]
SPEC = jn.GridSpec(GRID_LAT0, 1.0, GRID_NLAT, GRID_LON0, 1.0, GRID_NLON)
RAD = repr(CFG.radius_deg)


def hourly(t: Inputs, out: str = "tph") -> DataFrame:
    return ag.hourly_totals(t.cems, KEY, "t_hour", "nox_mass", out)


@query(
    "c01_box_join",
    """SELECT facility_id, scene, count(*) AS n_pix, CAST(sum(i) AS BIGINT) AS sum_i, CAST(sum(j) AS BIGINT) AS sum_j
    FROM fx_pixel p JOIN fx_facility f ON p.lat>f.lat-2e0 AND p.lat<f.lat+2e0 AND p.lon>f.lon-2e0 AND p.lon<f.lon+2e0 GROUP BY 1,2""",
    "fx_pixel fx_facility",
)
def c01(t: Inputs) -> DataFrame:
    places, members = jn.by_place(t.facility)
    hits = jn.box_join(jn.in_strips(t.pixel.select("scene", "i", "j", "lat", "lon"), "scene"), places, CFG.clip_buffer_deg)
    sums = hits.groupBy("facility_id", "scene").agg(
        F.count(F.lit(1)).alias("n_pix"), F.sum("i").alias("sum_i"), F.sum("j").alias("sum_j")
    )
    return jn.for_members(sums, members)


@query(
    "c02_step_metadata",
    """SELECT f.row_id, t.step_id, round(t.lat,6) AS lat FROM fx_flux f LEFT JOIN fx_trajectory t
    ON t.facility_id=f.facility_id AND t.step_id=f.nobs""",
    "fx_flux fx_trajectory",
)
def c02(t: Inputs) -> DataFrame:
    keys = t.flux.select("row_id", "facility_id", F.col("nobs").alias("step_id"))
    found = keys.join(t.trajectory.withColumn("found", F.col("step_id")), ["facility_id", "step_id"], "left")
    return found.select("row_id", F.col("found").alias("step_id"), F.round("lat", 6).alias("lat"))


@query(
    "c03_two_pass_merge",
    """WITH r AS (SELECT facility_id, step_id, lat FROM fx_trajectory)
    SELECT h.facility_id, h.step_id, round(h.lat,6) AS "lat_H", round(o.lat,6) AS "lat_O" FROM r h LEFT JOIN
    (SELECT * FROM r WHERE step_id%3<>0) o USING (facility_id, step_id)""",
    "fx_trajectory",
)
def c03(t: Inputs) -> DataFrame:
    h = t.trajectory.select(*KEY, "step_id", "lat", F.lit("H").alias("traj"))
    o = t.trajectory.where("step_id % 3 <> 0").select(*KEY, "step_id", "lat", F.lit("O").alias("traj"))
    wide = jn.wide_by_trajectory(h.unionByName(o), KEY, ["lat"])
    return wide.select(*KEY, "step_id", F.round("lat_H", 6).alias("lat_H"), F.round("lat_O", 6).alias("lat_O"))


SEGS = f"""{NEAR}, seg AS (SELECT facility_id, step_id, (lat+nlat)/2 AS lat, (lon+nlon)/2 AS lon,
  fmod({bear('lat','lon','nlat','nlon')}+90e0,360e0) AS pb FROM near WHERE nlat IS NOT NULL),
 dst AS (SELECT facility_id, step_id, k, k*0.5e0-100e0 AS d, lat, lon, radians(lat) AS phi, radians(pb) AS th,
  (k*0.5e0-100e0)/6371e0 AS de FROM seg, range(401) r(k)),
 dst2 AS (SELECT *, degrees(asin(sin(phi)*cos(de)+cos(phi)*sin(de)*cos(th))) AS lat_o FROM dst),
 pts AS (SELECT facility_id, step_id, k, d, lat_o, lon+degrees(atan2(sin(th)*sin(de)*cos(phi), cos(de)-sin(phi)*sin(radians(lat_o)))) AS lon_o
  FROM dst2)"""
PAIRS = f"""pix AS (SELECT scene, i, j, lat, lon, no2, CAST(floor(lat/{RAD}) AS BIGINT)+a AS cy, CAST(floor(lon/{RAD}) AS BIGINT)+b AS cx
  FROM fx_pixel, range(-1,2) x(a), range(-1,2) y(b) WHERE no2>=0 AND qa>=0.5e0),
 pairs AS (SELECT p.facility_id, step_id, k, d, i, j, no2, px.lat, px.lon, power(px.lon-lon_o,2)+power(px.lat-lat_o,2) AS d2
  FROM pts p JOIN fx_scenes s USING (facility_id) JOIN pix px ON px.scene=s.scene AND px.cy=CAST(floor(lat_o/{RAD}) AS BIGINT)
  AND px.cx=CAST(floor(lon_o/{RAD}) AS BIGINT) WHERE power(px.lon-lon_o,2)+power(px.lat-lat_o,2) < {RAD}*{RAD})"""


def scene_traj(t: Inputs) -> DataFrame:
    return t.trajectory.join(t.scenes, KEY)


def good_pixels(t: Inputs) -> DataFrame:
    return filter_pixels(t.pixel, CFG.qa_min)


@query(
    "h04_transect_points_all",
    f"WITH {SEGS} SELECT facility_id, step_id, k, round(lat_o,6) AS lat_ortho, round(lon_o,6) AS lon_ortho FROM pts",
    "fx_trajectory",
)
def h04_all(t: Inputs) -> DataFrame:
    """All 401 points of every transect."""
    return sm.transect_points(t.trajectory, KEY).select(
        *KEY, "step_id", F.col("k").cast("bigint").alias("k"), *[F.round(c, 6).alias(c) for c in ("lat_ortho", "lon_ortho")]
    )


@query(
    "h05_planar_transect",
    f"""WITH {NEAR}, seg AS (SELECT facility_id, step_id, (lat+nlat)/2 AS la, (lon+nlon)/2 AS lo,
      -1e0/((nlat-lat)/(nlon-lon+1e-99)+1e-99) AS sl FROM near WHERE nlat IS NOT NULL),
    p AS (SELECT *, k*0.01e0-0.5e0 AS sh FROM seg, range(100) r(k)),
    q AS (SELECT *, CASE WHEN abs(sl)>1 THEN la+sh ELSE la+sl*sh END AS y, CASE WHEN abs(sl)>1 THEN lo+sh/sl ELSE lo+sh END AS x,
      CASE WHEN abs(sl)>1 THEN la+(50*0.01e0-0.5e0) ELSE la+sl*(50*0.01e0-0.5e0) END AS ym,
      CASE WHEN abs(sl)>1 THEN lo+(50*0.01e0-0.5e0)/sl ELSE lo+(50*0.01e0-0.5e0) END AS xm FROM p)
    SELECT facility_id, step_id, round(sum(CASE WHEN (CASE WHEN abs(sl)>1e14 THEN y<ym ELSE x<xm END) THEN -{hav('ym','xm','y','x')} ELSE {hav('ym','xm','y','x')} END)/1e3,4) AS sum_km,
      round(sum(y),5) AS sum_lat, round(sum(x),5) AS sum_lon FROM q GROUP BY 1,2""",
    "fx_trajectory",
)
def h05(t: Inputs) -> DataFrame:
    pts = sm.planar_transect_points(t.trajectory, KEY, half_deg=0.5)
    return pts.groupBy(*KEY, "step_id").agg(
        F.round(F.sum("dist_ortho"), 4).alias("sum_km"),
        F.round(F.sum("lat_ortho"), 5).alias("sum_lat"),
        F.round(F.sum("lon_ortho"), 5).alias("sum_lon"),
    )


@query(
    "c04_mean_within_range",
    f"""WITH {SEGS}, {PAIRS}, m AS (SELECT facility_id, step_id, k, avg(no2) AS v, avg(lon) AS lo, avg(lat) AS la FROM pairs GROUP BY 1,2,3)
    SELECT facility_id, step_id, count(*) AS n, round(avg(v),8) AS no2, round(radians(avg(la)),9) AS lat, round(radians(avg(lo)),9) AS lon,
    CAST(sum(k) AS BIGINT) AS sum_k FROM m GROUP BY 1,2 HAVING count(*)>=3""",
    "fx_trajectory fx_pixel fx_scenes",
)
def c04(t: Inputs) -> DataFrame:
    s = sm.sample_transects(good_pixels(t), scene_traj(t), ["facility_id", "scene"], ["scene"], CFG, columns=["k", "lat_sampled", "lon_sampled"])
    return s.groupBy(*KEY, "step_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("no2"), 8).alias("no2"),
        F.round(F.radians(F.avg("lat_sampled")), 9).alias("lat"),
        F.round(F.radians(F.avg("lon_sampled")), 9).alias("lon"),
        F.sum("k").alias("sum_k"),
    )


@query(
    "c05_nearest_point",
    f"""WITH {SEGS}, {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY facility_id, step_id, i, j ORDER BY d2, k) AS rn FROM pairs)
    SELECT facility_id, step_id, count(*) AS n, round(avg(no2),6) AS no2, CAST(sum(k) AS BIGINT) AS sum_k FROM r WHERE rn=1
    GROUP BY 1,2 HAVING count(*)>=3""",
    "fx_trajectory fx_pixel fx_scenes",
)
def c05(t: Inputs) -> DataFrame:
    from dataclasses import replace

    s = sm.sample_transects(good_pixels(t), scene_traj(t), ["facility_id", "scene"], ["scene"], replace(CFG, sample_mode="nearest"), columns=["k"])
    return s.groupBy(*KEY, "step_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("no2"), 6).alias("no2"), F.sum("k").alias("sum_k")
    )


EMIT = """em AS (SELECT row_id, facility_id, epoch_us(t_overpass) - CAST(round(age_hours*3600000000e0) AS BIGINT) AS te FROM fx_flux),
 cand AS (SELECT row_id, te, epoch_us(h.t_hour) AS th, tph, row_number() OVER (PARTITION BY row_id ORDER BY abs(te-epoch_us(h.t_hour)), h.t_hour) AS rn
  FROM em JOIN fx_hourly h USING (facility_id))"""


@query(
    "c06_nearest_hour",
    f"""WITH {EMIT}, best AS (SELECT * FROM cand WHERE rn=1 AND abs(te-th)<=1800000000)
    SELECT em.row_id, round(tph,9) AS tph, th AS t_match_us, round(abs(best.te-th)/1000000e0,6) AS dt_sec
    FROM em LEFT JOIN best USING (row_id)""",
    "fx_flux fx_hourly",
)
def c06(t: Inputs) -> DataFrame:
    rows = t.flux.select("row_id", "facility_id", T.minus_hours("t_overpass", "age_hours").alias("t_emission"))
    m = jn.hourly_match(rows, hourly(t), KEY, "t_emission", "t_hour", "tph", CFG.match_tol_hours)
    return m.select(
        "row_id",
        F.round("tph", 9).alias("tph"),
        T.micros("cems_t_emit").alias("t_match_us"),
        F.round(F.col("cems_dt_hrs") * 3600.0, 6).alias("dt_sec"),
    )


@query(
    "c06_nearest_record_wide_tolerance",
    f"""WITH {EMIT}, best AS (SELECT * FROM cand WHERE rn=1 AND abs(te-th)<=3*3600000000)
    SELECT em.row_id, round(tph,9) AS tph, th AS t_match_us FROM em LEFT JOIN best USING (row_id)""",
    "fx_flux fx_hourly",
)
def c06w(t: Inputs) -> DataFrame:
    rows = t.flux.select("row_id", "facility_id", T.minus_hours("t_overpass", "age_hours").alias("t_emission"))
    right = hourly(t).withColumn("ord", T.micros("t_hour"))
    m = jn.asof_nearest(rows, right, KEY, "t_emission", "t_hour", "row_id", "ord", ["tph"], tol_hours=3.0)
    return m.select("row_id", F.round("tph", 9).alias("tph"), T.micros("matched_time").alias("t_match_us"))


LOOK = """look AS (SELECT overpass_id, o.facility_id, t_start, h.t_hour, tph FROM fx_overpass o JOIN fx_hourly h ON h.facility_id=o.facility_id
 AND h.t_hour<=t_start AND h.t_hour>=t_start - INTERVAL 6 HOUR)"""


@query(
    "c07_lookback",
    f"WITH {LOOK} SELECT overpass_id, epoch_us(t_hour) AS hour_us, round(tph,9) AS tph FROM look",
    "fx_overpass fx_hourly",
)
def c07(t: Inputs) -> DataFrame:
    rows = jn.lookback_join(t.overpass, hourly(t), KEY, "t_start", "t_hour", CFG.lookback_hours)
    return rows.select("overpass_id", T.micros("t_hour").alias("hour_us"), F.round("tph", 9).alias("tph"))


@query(
    "c15_overpass_mean_attach",
    f"""WITH {LOOK}, m AS (SELECT overpass_id, facility_id, avg(tph) AS cems_mean FROM look GROUP BY 1,2),
    f AS (SELECT facility_id, avg(tph) AS fac_mean, stddev_samp(tph) AS fac_std FROM look GROUP BY 1)
    SELECT o.overpass_id, round(cems_mean,9) AS cems_mean, round(fac_mean,9) AS fac_mean, round(fac_std,9) AS fac_std
    FROM fx_overpass o LEFT JOIN m USING (overpass_id) LEFT JOIN f ON f.facility_id=o.facility_id""",
    "fx_overpass fx_hourly",
)
def c15(t: Inputs) -> DataFrame:
    rows = jn.lookback_join(t.overpass, hourly(t), KEY, "t_start", "t_hour", CFG.lookback_hours)
    per = ag.mean_and_std(rows, ["overpass_id"], "tph", "cems_mean")
    fac = ag.mean_and_std(rows, KEY, "tph", "fac_mean", "fac_std")
    out = t.overpass.join(per, "overpass_id", "left").join(fac, KEY, "left")
    return out.select("overpass_id", *[F.round(c, 9).alias(c) for c in ("cems_mean", "fac_mean", "fac_std")])


@query(
    "d19_window_summary",
    f"""WITH {LOOK}, e AS (SELECT overpass_id, max(t_hour) AS te, avg(tph) AS m FROM look GROUP BY 1)
    SELECT overpass_id, epoch_us(t_hour) AS hour_us, round(m,9) AS window_mean,
    round((epoch_us(te)-epoch_us(t_hour))/3600000000e0,6) AS transport_hrs FROM look JOIN e USING (overpass_id)""",
    "fx_overpass fx_hourly",
)
def d19(t: Inputs) -> DataFrame:
    rows = jn.lookback_join(t.overpass, hourly(t), KEY, "t_start", "t_hour", CFG.lookback_hours)
    s = ag.window_summary(rows.select("overpass_id", "t_hour", "tph"), ["overpass_id"], "t_hour", "tph")
    return s.select(
        "overpass_id",
        T.micros("t_hour").alias("hour_us"),
        F.round("window_mean", 9).alias("window_mean"),
        F.round("transport_hrs", 6).alias("transport_hrs"),
    )


@query(
    "c08_nearest_overpass",
    """WITH o AS (SELECT overpass_id, facility_id, epoch_us(t_start)+50000000 AS tm FROM fx_overpass),
    s AS (SELECT event_id, user_id AS facility_id, epoch_us(ts) AS t2 FROM events WHERE event_type='signup'),
    r AS (SELECT event_id, t2, overpass_id, tm, row_number() OVER (PARTITION BY event_id ORDER BY abs(t2-tm), overpass_id) AS rn FROM s JOIN o USING (facility_id))
    SELECT s.event_id, overpass_id, round((r.t2-tm)/1000000e0,6) AS dt_sec FROM s LEFT JOIN (SELECT * FROM r WHERE rn=1) r USING (event_id)""",
    "fx_overpass",
)
def c08(t: Inputs) -> DataFrame:
    second = t.events.where("event_type = 'signup'").select("event_id", F.col("user_id").alias("facility_id"), "ts")
    mids = t.overpass.withColumn("t_mid", T.midpoint("t_start", "t_end"))
    m = jn.asof_nearest(second, mids, KEY, "ts", "t_mid", "event_id", "overpass_id", ["overpass_id"])
    return m.select("event_id", "overpass_id", F.round(F.col("dt_hours") * 3600.0, 6).alias("dt_sec"))


@query(
    "c09_nearest_pixel",
    """WITH a AS (SELECT t.facility_id, t.step_id, s.scene, t.lat+0.3e0*(t.step_id%9) AS lat, t.lon+0.0007e0*t.step_id AS lon
      FROM fx_trajectory t JOIN fx_scenes s USING (facility_id)),
    r AS (SELECT a.facility_id, a.step_id, i, j, row_number() OVER (PARTITION BY a.facility_id, a.step_id
      ORDER BY power(p.lon-a.lon,2)+power(p.lat-a.lat,2), i, j) AS rn FROM a JOIN fx_pixel p USING (scene))
    SELECT facility_id, step_id, i, j FROM r WHERE rn=1""",
    "fx_trajectory fx_scenes fx_pixel",
)
def c09(t: Inputs) -> DataFrame:
    pts = scene_traj(t).select(
        *KEY,
        "step_id",
        "scene",
        (F.col("lat") + 0.3 * (F.col("step_id") % 9)).alias("plat"),
        (F.col("lon") + 0.0007 * F.col("step_id")).alias("plon"),
    )
    return jn.nearest_pixel(pts, t.pixel, ["scene"], [*KEY, "step_id"], "plat", "plon").select(*KEY, "step_id", "i", "j")


@query(
    "c10_nearest_path_row",
    f"""WITH w AS (SELECT row_id, facility_id, 35e0+((row_id*17)%400)/1000e0 AS wlat, -95e0+((row_id*29)%400)/1000e0 AS wlon FROM fx_flux),
    r AS (SELECT row_id, step_id, row_number() OVER (PARTITION BY row_id ORDER BY {hav('wlat','wlon','lat','lon')}, step_id) AS rn
      FROM w JOIN fx_trajectory USING (facility_id))
    SELECT row_id, step_id FROM r WHERE rn=1""",
    "fx_flux fx_trajectory",
)
def c10(t: Inputs) -> DataFrame:
    rid = F.col("row_id")
    ways = t.flux.select(
        rid, *KEY, (35.0 + ((rid * 17) % 400) / 1000.0).alias("lat"), (-95.0 + ((rid * 29) % 400) / 1000.0).alias("lon")
    )
    return jn.nearest_path_row(ways, t.trajectory, KEY, ["row_id"], ["tstmp"]).select("row_id", "step_id")


@query(
    "c11_grid_interpolation",
    """SELECT overpass_id, round((2.5e-8+1e-10*lat+2e-10*lon)*1e9,6) AS o3_ppb, round(290e0+0.1e0*lat,6) AS t_k
    FROM fx_overpass JOIN fx_facility USING (facility_id)""",
    "fx_overpass fx_facility",
)
def c11(t: Inputs) -> DataFrame:
    pts = t.overpass.join(t.facility, KEY).withColumn("vt", F.date_trunc("day", "t_start"))
    v = jn.grid_interp(pts, t.grid, SPEC, ["overpass_id"], "vt", ["o3", "t_k"])
    return v.select("overpass_id", F.round(F.col("o3") * 1e9, 6).alias("o3_ppb"), F.round("t_k", 6).alias("t_k"))


@query(
    "c12_profile_mean",
    """SELECT overpass_id, round(sum((lev+1)*(2.5e-8+1e-10*lat+2e-10*lon)*(1+0.1e0*lev))*1e9/sum(lev+1),6) AS mean_ppb
    FROM fx_overpass JOIN fx_facility USING (facility_id), range(4) l(lev) GROUP BY overpass_id""",
    "fx_overpass fx_facility",
)
def c12(t: Inputs) -> DataFrame:
    pts = t.overpass.join(t.facility, KEY).withColumn("vt", F.date_trunc("day", "t_start"))
    field = t.grid.withColumn("lev", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumns(
        {"o3": F.col("o3") * (1 + 0.1 * F.col("lev")), "delp": -(F.col("lev") + 1.0)}
    )
    prof = jn.grid_interp(pts.select("overpass_id", "vt", "lat", "lon"), field, SPEC, ["overpass_id"], "vt", ["o3", "delp"], also=["lev"])
    m = jn.thickness_mean(prof, ["overpass_id"], "o3", "delp", "m")
    return m.select("overpass_id", F.round(F.col("m") * 1e9, 6).alias("mean_ppb"))


@query(
    "c13_semi_join",
    """SELECT facility_id, step_id FROM fx_trajectory WHERE (facility_id, step_id) IN (SELECT facility_id, nobs FROM fx_flux WHERE qf=0)""",
    "fx_trajectory fx_flux",
)
def c13(t: Inputs) -> DataFrame:
    fitted = t.flux.where("qf = 0").select(*KEY, F.col("nobs").alias("step_id"))
    return t.trajectory.join(fitted, [*KEY, "step_id"], "left_semi").select(*KEY, "step_id")


@query(
    "c14_anti_join",
    "SELECT overpass_id FROM fx_overpass WHERE overpass_id+1 NOT IN (SELECT row_id FROM fx_flux)",
    "fx_overpass fx_flux",
)
def c14(t: Inputs) -> DataFrame:
    done = t.flux.select((F.col("row_id") - 1).alias("overpass_id"))
    return t.overpass.join(done, "overpass_id", "left_anti").select("overpass_id")


@query(
    "a12_required_days",
    """WITH d AS (SELECT overpass_id, unnest(generate_series(CAST(t_start - INTERVAL 2 HOUR AS DATE)::TIMESTAMP, CAST(t_start + INTERVAL 7 HOUR AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM fx_overpass),
    have AS (SELECT DISTINCT CAST(ts AS DATE)::TIMESTAMP AS day FROM events WHERE event_type='purchase')
    SELECT epoch_us(day) AS day_us, count(*) AS n_runs, day NOT IN (SELECT day FROM have) AS is_missing FROM d GROUP BY 1,3""",
    "fx_overpass",
)
def a12(t: Inputs) -> DataFrame:
    from plumeflux.sources.requirements import missing_days, required_days

    need = required_days(t.overpass, "t_start")
    have = t.events.where("event_type = 'purchase'").select(F.to_date("ts").alias("day")).distinct()
    lost = missing_days(need, have).withColumn("is_missing", F.lit(True))
    counts = need.groupBy("day").agg(F.count(F.lit(1)).alias("n_runs")).join(lost, "day", "left")
    return counts.select(
        T.micros("day").alias("day_us"), "n_runs", F.coalesce("is_missing", F.lit(False)).alias("is_missing")
    )


@query(
    "h13_local_to_utc",
    """WITH l AS (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey%24 AS BIGINT)) AS lt,
      CASE o_orderkey%4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Chicago' WHEN 2 THEN 'America/Denver' ELSE 'America/Phoenix' END AS tz FROM orders),
    u AS (SELECT *, timezone('UTC', timezone(tz, lt)) AS ut FROM l),
    v AS (SELECT *, timezone(tz, timezone('UTC', ut)) AS b0, timezone(tz, timezone('UTC', ut + INTERVAL 1 HOUR)) AS b1,
      timezone(tz, timezone('UTC', ut - INTERVAL 1 HOUR)) AS b2 FROM u)
    SELECT o_orderkey, CASE WHEN b0=lt AND b1<>lt AND b2<>lt THEN epoch_us(ut) END AS utc_us FROM v""",
)
def h13(t: Inputs) -> DataFrame:
    key = F.col("o_orderkey")
    zone = F.when(key % 4 == 0, "America/New_York").when(key % 4 == 1, "America/Chicago").when(key % 4 == 2, "America/Denver")
    rows = t.table("orders").select(
        key,
        (F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(key % 24).cast("int"))).alias("lt"),
        zone.otherwise("America/Phoenix").alias("tz"),
    )
    return rows.select("o_orderkey", T.micros(T.local_to_utc("lt", "tz")).alias("utc_us"))


@query(
    "h01_haversine",
    f"SELECT facility_id, round({hav('lat','lon','35e0','-95e0')}/1e3,6) AS km, round({bear('lat','lon','35e0','-95e0')},6) AS deg FROM fx_facility",
    "fx_facility",
)
def h01(t: Inputs) -> DataFrame:
    from plumeflux.functions.geo import bearing_deg, haversine_m

    return t.facility.select(
        "facility_id",
        F.round(haversine_m("lat", "lon", 35.0, -95.0) / 1e3, 6).alias("km"),
        F.round(bearing_deg("lat", "lon", 35.0, -95.0), 6).alias("deg"),
    )


@query(
    "h04_destination",
    """WITH p AS (SELECT facility_id, lat, lon, radians(lat) AS phi, radians(CAST(facility_id*37%360 AS DOUBLE)) AS th, (facility_id%50)/6371e0 AS de FROM fx_facility),
    q AS (SELECT *, degrees(asin(sin(phi)*cos(de)+cos(phi)*sin(de)*cos(th))) AS lat_end FROM p)
    SELECT facility_id, round(lat_end,6) AS lat_end, round(lon+degrees(atan2(sin(th)*sin(de)*cos(phi),cos(de)-sin(phi)*sin(radians(lat_end)))),6) AS lon_end FROM q""",
    "fx_facility",
)
def h04d(t: Inputs) -> DataFrame:
    fid = F.col("facility_id")
    lat, lon = destination("lat", "lon", ((fid * 37) % 360).cast("double"), (fid % 50).cast("double"))
    return t.facility.select(fid, F.round(lat, 6).alias("lat_end"), F.round(lon, 6).alias("lon_end"))
