"""Registered queries for grouped summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeflux.fixtures import Inputs
from plumeflux.functions import timeconv as T
from plumeflux.operators import aggregates as ag
from plumeflux.plans.registry import query
from plumeflux.plans.series_queries import NEAR, bear, hav

KEY = ["facility_id"]


@query(
    "d01_clip_stats",
    """SELECT scene, count(*) AS n_data, min(i) AS scanline_i0, max(i)+1 AS scanline_i1, min(j) AS pixel_j0, max(j)+1 AS pixel_j1,
    round(min(lat),6) AS latmin, round(max(lat),6) AS latmax, round(min(lon),6) AS lonmin, round(max(lon),6) AS lonmax,
    epoch_us(min(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(i))) AS ti, epoch_us(max(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(i))) AS tf
    FROM fx_pixel GROUP BY 1""",
    "fx_pixel",
)
def d01(t: Inputs) -> DataFrame:
    timed = t.pixel.withColumn("t_utc", T.from_micros(F.lit(1704067200000000) + F.col("i") * 1000000))
    s = ag.clip_stats(timed, ["scene"])
    return s.select(
        "scene",
        "n_data",
        *["scanline_i0", "scanline_i1", "pixel_j0", "pixel_j1"],
        *[F.round(c, 6).alias(c) for c in ("latmin", "latmax", "lonmin", "lonmax")],
        T.micros("time_utc_i").alias("ti"),
        T.micros("time_utc_f").alias("tf"),
    )


@query("d02_hourly_totals", "SELECT facility_id, epoch_us(t_hour) AS hour_us, round(tph,9) AS tph FROM fx_hourly", "fx_hourly")
def d02(t: Inputs) -> DataFrame:
    h = ag.hourly_totals(t.cems, KEY, "t_hour", "nox_mass", "tph")
    return h.select("facility_id", T.micros("t_hour").alias("hour_us"), F.round("tph", 9).alias("tph"))


@query(
    "d03_facility_mean_std",
    "SELECT facility_id, round(avg(tph),9) AS mean_tph, round(stddev_samp(tph),9) AS std_tph FROM fx_hourly GROUP BY 1",
    "fx_hourly",
)
def d03(t: Inputs) -> DataFrame:
    h = ag.hourly_totals(t.cems, KEY, "t_hour", "nox_mass", "tph")
    s = ag.mean_and_std(h, KEY, "tph", "mean_tph", "std_tph")
    return s.select("facility_id", F.round("mean_tph", 9).alias("mean_tph"), F.round("std_tph", 9).alias("std_tph"))


WD = f"""{NEAR}, w AS (SELECT facility_id, radians(CASE WHEN step_id=0 THEN {bear('lat','lon','nlat','nlon')}
 ELSE {bear('lat0','lon0','lat','lon')} END) AS r FROM near)"""


@query(
    "d06_circular_std",
    f"""WITH {WD} SELECT facility_id, round(degrees(sqrt(-2*ln(least(sqrt(power(avg(sin(r)),2)+power(avg(cos(r)),2)),1e0)))),4) AS wd_std
    FROM w GROUP BY 1""",
    "fx_trajectory",
)
def d06(t: Inputs) -> DataFrame:
    from plumeflux.operators.trajectory import with_kinematics

    s = ag.circular_std(with_kinematics(t.trajectory, KEY, None), KEY, "wd")
    return s.select("facility_id", F.round("wd_std", 4).alias("wd_std"))


@query(
    "d07_wind_std",
    f"""WITH {NEAR}, w AS (SELECT facility_id, {hav('lat','lon','lat','nlon')} AS u, {hav('lat','nlon','nlat','nlon')} AS v FROM near)
    SELECT facility_id, round(stddev_samp(u),4) AS u_std, round(stddev_samp(v),4) AS v_std FROM w GROUP BY 1""",
    "fx_trajectory",
)
def d07(t: Inputs) -> DataFrame:
    from pyspark.sql import Window

    from plumeflux.functions.geo import haversine_m
    from plumeflux.operators.series import SEG, halo_segments

    w = Window.partitionBy("facility_id", SEG).orderBy("step_id")
    near = halo_segments(t.trajectory).withColumns({"nlat": F.lead("lat").over(w), "nlon": F.lead("lon").over(w)})
    legs = near.where("__core").select(
        "facility_id",
        haversine_m("lat", "lon", "lat", "nlon").alias("u"),
        haversine_m("lat", "nlon", "nlat", "nlon").alias("v"),
    )
    s = ag.wind_std(legs, KEY)
    return s.select("facility_id", F.round("u_std", 4).alias("u_std"), F.round("v_std", 4).alias("v_std"))


@query(
    "d08_scene_background",
    """SELECT scene, round(median(no2),6) AS bg, round(quantile_cont(no2,0.75)-quantile_cont(no2,0.25),6) AS bg_iqr,
    round(quantile_cont(no2,0.25),6) AS bg_low FROM fx_pixel GROUP BY 1""",
    "fx_pixel",
)
def d08(t: Inputs) -> DataFrame:
    bg = ag.scene_background(t.pixel, ["scene"])
    low = ag.scene_background(t.pixel, ["scene"], low_quartile=True).select("scene", F.col("bg").alias("bg_low"))
    return bg.join(low, "scene").select("scene", *[F.round(c, 6).alias(c) for c in ("bg", "bg_iqr", "bg_low")])


@query(
    "d10_mad_outliers",
    """WITH m AS (SELECT facility_id, median(flux) AS med FROM fx_flux GROUP BY 1),
    d AS (SELECT facility_id, median(abs(flux-med)) AS mad FROM fx_flux JOIN m USING (facility_id) GROUP BY 1)
    SELECT row_id, flux > med+3*mad AS is_far, abs(flux) <= 3*(mad+1e-9) AS is_near
    FROM fx_flux JOIN m USING (facility_id) JOIN d USING (facility_id)""",
    "fx_flux",
)
def d10(t: Inputs) -> DataFrame:
    return ag.mad_outliers(t.flux.select("row_id", "facility_id", "flux"), KEY, "flux", 3.0).select("row_id", "is_far", "is_near")


@query(
    "d11_regression",
    """SELECT facility_id, count(*) AS n, round(CASE WHEN count(*)>=3 AND var_pop(nobs)>0 THEN regr_slope(flux, nobs) END,6) AS slope,
    round(CASE WHEN count(*)>=3 AND var_pop(nobs)>0 THEN regr_intercept(flux, nobs) END,6) AS intercept,
    round(CASE WHEN count(*)>=3 AND var_pop(nobs)>0 AND var_pop(flux)>0 THEN corr(flux, nobs) END,6) AS r FROM fx_flux WHERE nobs>0 GROUP BY 1""",
    "fx_flux",
)
def d11(t: Inputs) -> DataFrame:
    s = ag.regression(t.flux.where("nobs > 0"), KEY, "nobs", "flux")
    return s.select("facility_id", "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r")])


@query(
    "d12_latest_facility",
    """SELECT c_custkey AS facility_id, arg_max(o_totalprice, epoch_us(o_orderdate)*1000000 + o_orderkey) AS price,
    arg_max(o_orderpriority, epoch_us(o_orderdate)*1000000 + o_orderkey) AS fuel
    FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1""".replace("epoch_us(o_orderdate)*1000000", "epoch(o_orderdate)::BIGINT*1000000"),
)
def d12(t: Inputs) -> DataFrame:
    yearly = t.table("orders").select(
        F.col("o_custkey").alias("facility_id"), "o_orderdate", "o_orderkey", "o_totalprice", "o_orderpriority"
    )
    known = t.table("customer").select(F.col("c_custkey").alias("facility_id"))
    latest = ag.latest_per_key(
        yearly.join(known, "facility_id", "left_semi"),
        "facility_id",
        ["o_orderdate", "o_orderkey"],
        {"o_totalprice": "price", "o_orderpriority": "fuel"},
    )
    return latest.select("facility_id", "price", "fuel")


@query(
    "d13_binned_regression",
    """WITH b(t0,t1) AS (VALUES (0e0,10e0),(10e0,30e0),(20e0,60e0))
    SELECT facility_id, t0, t1, count(*) AS n, round(CASE WHEN count(*)>=3 AND var_pop(nobs)>0 THEN regr_slope(flux, nobs) END,6) AS slope,
    round(CASE WHEN count(*)>=3 AND var_pop(nobs)>0 THEN regr_intercept(flux, nobs) END,6) AS intercept,
    round(CASE WHEN count(*)>=3 AND var_pop(nobs)>0 AND var_pop(flux)>0 THEN corr(flux, nobs) END,6) AS r
    FROM fx_flux, b WHERE age_hours*60>=t0 AND age_hours*60<t1 GROUP BY 1,2,3""",
    "fx_flux",
)
def d13(t: Inputs) -> DataFrame:
    rows = ag.binned(
        t.flux.withColumn("transport_min", F.col("age_hours") * 60), "transport_min", [(0, 10), (10, 30), (20, 60)]
    )
    s = ag.regression(rows, ["facility_id", "t0", "t1"], "nobs", "flux")
    return s.select("facility_id", "t0", "t1", "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r")])


@query(
    "d14_youngest_row",
    """SELECT facility_id, arg_min(flux, age_hours*1e9+row_id*1e-3) AS flux_young,
    arg_min(rsq_detrend, age_hours*1e9+row_id*1e-3) FILTER (qf=0) AS rsq_young, round(min(abs(age_hours))*60,6) AS transport_min
    FROM fx_flux GROUP BY 1""",
    "fx_flux",
)
def d14(t: Inputs) -> DataFrame:
    rows = t.flux.withColumn("good", F.when(F.col("qf") == 0, F.col("rsq_detrend")))
    s = ag.youngest_values(rows, KEY, "age_hours", {"flux_young": "flux", "rsq_young": "good"}, "row_id")
    return s.withColumn("transport_min", F.round("transport_min", 6))


@query(
    "d15_ingest_report",
    """SELECT count(*) AS total, count(*) FILTER (event_type='view') AS overlap, count(*) FILTER (event_type<>'view') AS no_overlap,
    count(*) FILTER (event_type='error') AS errors FROM events""",
)
def d15(t: Inputs) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "clip_error").otherwise("ok")
    return ag.ingest_report(t.events.select((F.col("event_type") == "view").alias("overlap"), status.alias("status")))


@query(
    "d16_rank_limits",
    """WITH r AS (SELECT scene, no2, row_number() OVER (PARTITION BY scene ORDER BY no2)-1 AS k, count(*) OVER (PARTITION BY scene) AS n
      FROM fx_pixel WHERE qa>0.5e0)
    SELECT scene, max(n) AS n, round(max(CASE WHEN k=CAST(floor(n*0.02e0) AS BIGINT) THEN no2 END),6) AS vmin,
    round(max(CASE WHEN k=CAST(floor(n*0.98e0) AS BIGINT) THEN no2 END),6) AS vmax FROM r GROUP BY 1""",
    "fx_pixel",
)
def d16(t: Inputs) -> DataFrame:
    s = ag.rank_limits(t.pixel.where("qa > 0.5"), ["scene"], "no2", 0.02, 0.98)
    return s.select("scene", "n", F.round("vmin", 6).alias("vmin"), F.round("vmax", 6).alias("vmax"))


@query(
    "d17_group_size",
    """SELECT row_id FROM fx_flux JOIN (SELECT facility_id, nobs FROM fx_flux GROUP BY 1,2 HAVING count(*)>=3) g USING (facility_id, nobs)""",
    "fx_flux",
)
def d17(t: Inputs) -> DataFrame:
    return ag.at_least(t.flux, ["facility_id", "nobs"], 3).select("row_id")


@query(
    "d18_scene_wind",
    """SELECT facility_id, round(avg(CASE WHEN qf=0 THEN flux END),6) AS wso_mean,
    round(stddev_samp(CASE WHEN qf=0 THEN flux END),6) AS wso_std FROM fx_flux GROUP BY 1""",
    "fx_flux",
)
def d18(t: Inputs) -> DataFrame:
    wind = t.flux.withColumn("wso", F.when(F.col("qf") == 1, F.lit(-9999.0)).otherwise(F.col("flux")))
    s = ag.scene_wind(wind, KEY)
    return s.select("facility_id", F.round("wso_mean", 6).alias("wso_mean"), F.round("wso_std", 6).alias("wso_std"))


@query(
    "d20_pair_statistics",
    """WITH s AS (SELECT scene, CASE WHEN qa>=0.5e0 THEN 'first' ELSE 'second' END AS sensor, no2 FROM fx_pixel),
    q AS (SELECT scene, quantile_cont(no2,0.02) AS vmin, quantile_cont(no2,0.98) AS vmax FROM s GROUP BY 1)
    SELECT scene, sensor, count(*) AS n_pix, round(min(no2),6) AS v_min, round(max(no2),6) AS v_max,
    round(max(vmin),6) AS vmin, round(max(vmax),6) AS vmax FROM s JOIN q USING (scene) GROUP BY 1,2""",
    "fx_pixel",
)
def d20(t: Inputs) -> DataFrame:
    rows = t.pixel.withColumn("sensor", F.when(F.col("qa") >= 0.5, "first").otherwise("second"))
    s = ag.pair_statistics(rows, "scene", "sensor", "no2")
    return s.select("scene", "sensor", "n_pix", *[F.round(c, 6).alias(c) for c in ("v_min", "v_max", "vmin", "vmax")])
