"""Registered queries for filters, flags and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeflux.config import FluxConfig
from plumeflux.fixtures import Inputs
from plumeflux.functions import chemistry, geo
from plumeflux.functions import timeconv as T
from plumeflux.operators import filters as fl
from plumeflux.operators import aggregates as ag
from plumeflux.plans.registry import query

CFG = FluxConfig()


@query(
    "b01_bounding_box",
    "SELECT scene,i,j FROM fx_pixel WHERE lat>36e0-0.8e0 AND lat<36e0+0.8e0 AND lon>-93.5e0-0.8e0 AND lon<-93.5e0+0.8e0",
    "fx_pixel",
)
def b01(t: Inputs) -> DataFrame:
    return t.pixel.where(fl.around("lat", "lon", 36.0, -93.5, 0.8)).select("scene", "i", "j")


@query(
    "b02_dateline_box",
    """WITH s AS (SELECT facility_id, lat, fmod(fmod(lon-90e0+180e0,360e0)+360e0,360e0)-180e0 AS lon FROM fx_facility)
    SELECT facility_id, round(lon,6) AS lon FROM s WHERE lat>30e0 AND lat<40e0 AND (lon>178e0 OR lon<-175e0)""",
    "fx_facility",
)
def b02(t: Inputs) -> DataFrame:
    moved = t.facility.withColumn("lon", geo.wrap_lon(F.col("lon") - 90.0))
    box = geo.in_box("lat", "lon", 30.0, 40.0, 178.0, 185.0)
    return moved.where(box).select("facility_id", F.round("lon", 6).alias("lon"))


def granule_extents(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(F.col("scene").alias("granule_id")).agg(F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"))


@query(
    "b03_granule_pruning",
    """WITH g AS (SELECT scene AS granule_id, min(lat) AS lo, max(lat) AS hi FROM fx_pixel GROUP BY 1)
    SELECT granule_id, facility_id FROM g, fx_facility WHERE NOT (lat+2e0 < lo OR lat-2e0 > hi)""",
    "fx_pixel fx_facility",
)
def b03(t: Inputs) -> DataFrame:
    return fl.prune_granules(granule_extents(t.pixel), t.facility, 2.0)


@query(
    "b04_index_rectangle",
    """WITH r AS (SELECT scene, min(i) AS i0, max(i)+1 AS i1, min(j) AS j0, max(j)+1 AS j1 FROM fx_pixel
      WHERE no2 > 70e0 AND lat>35.3e0 GROUP BY 1)
    SELECT p.scene, i, j, i0, i1, j0, j1 FROM fx_pixel p JOIN r ON p.scene=r.scene AND i>=i0 AND i<i1 AND j>=j0 AND j<j1""",
    "fx_pixel",
)
def b04(t: Inputs) -> DataFrame:
    rects = fl.index_rectangles(t.pixel.where("no2 > 70 AND lat > 35.3"), ["scene"])
    return fl.pixels_in_rectangles(t.pixel, rects, ["scene"]).select("scene", "i", "j", "i0", "i1", "j0", "j1")


@query("b05_keep_list", "SELECT row_id, flux, nobs FROM fx_flux", "fx_flux")
def b05(t: Inputs) -> DataFrame:
    return fl.keep_columns(t.flux, ["flux", "averaging_kernel", "nobs"], always=["row_id"])


@query("b06_pixel_quality", "SELECT scene,i,j FROM fx_pixel WHERE no2>=0 AND qa>=0.5e0", "fx_pixel")
def b06(t: Inputs) -> DataFrame:
    return fl.filter_pixels(t.pixel, CFG.qa_min).select("scene", "i", "j")


@query(
    "b07_display_quality",
    """SELECT 'first' AS sensor, scene,i,j FROM fx_pixel WHERE qa>=0.5e0 AND no2>0 AND lat>33.5e0 AND lat<38.5e0 AND lon>-95.5e0 AND lon<-90.5e0
    UNION ALL SELECT 'second', scene,i,j FROM fx_pixel WHERE qa<0.5e0 AND no2>0 AND lat>33.5e0 AND lat<38.5e0 AND lon>-95.5e0 AND lon<-90.5e0""",
    "fx_pixel",
)
def b07(t: Inputs) -> DataFrame:
    box = fl.around("lat", "lon", 36.0, -93.0, CFG.map_buffer_deg)
    one = fl.display_pixels(t.pixel, box, CFG.qa_min).select(F.lit("first").alias("sensor"), "scene", "i", "j")
    two = fl.second_sensor_pixels(t.pixel, box, CFG.second_sensor_quality_max, quality="qa")
    return one.unionByName(two.select(F.lit("second").alias("sensor"), "scene", "i", "j"))


@query(
    "b08_date_range",
    """SELECT overpass_id FROM fx_overpass WHERE t_start >= TIMESTAMP '2024-01-05 00:00:00' AND t_start <= TIMESTAMP '2024-01-20 00:00:00'""",
    "fx_overpass",
)
def b08(t: Inputs) -> DataFrame:
    return fl.select_overpasses(t.overpass, "2024-01-05", "2024-01-20").select("overpass_id")


@query(
    "b09_pair_filter",
    """SELECT overpass_id FROM (SELECT overpass_id, overpass_id%3<>0 AS overlap, overpass_id%5 AS n_pts,
      (overpass_id*7)%900-450e0 AS dt_min FROM fx_overpass) p WHERE overlap AND n_pts>0 AND abs(dt_min)<=360""",
    "fx_overpass",
)
def b09(t: Inputs) -> DataFrame:
    oid = F.col("overpass_id")
    pairs = t.overpass.select(
        oid, (oid % 3 != 0).alias("overlap"), (oid % 5).alias("n_pts"), ((oid * 7) % 900 - 450.0).alias("dt_min")
    )
    return fl.usable_pairs(pairs, CFG.pair_max_hours).select("overpass_id")


QUALITY = """q AS (SELECT row_id, rsq_detrend-0.05e0 AS rsq_detrend, CAST(row_id%60 AS DOUBLE) AS d_gap,
 CAST(row_id%45-30 AS DOUBLE) AS d_left, CAST(row_id%47-30 AS DOUBLE) AS d_right, CAST(row_id%37 AS DOUBLE) AS d_center,
 CASE WHEN row_id%17=0 THEN NULL ELSE CAST(row_id%61 AS DOUBLE) END AS a2sigpct,
 CAST(row_id%59 AS DOUBLE) AS a4sigpct, nobs FROM fx_flux)"""


def quality_rows(t: Inputs) -> DataFrame:
    rid = F.col("row_id")

    def d(c):
        return c.cast("double")

    return t.flux.select(
        rid,
        (F.col("rsq_detrend") - 0.05).alias("rsq_detrend"),
        d(rid % 60).alias("d_gap"),
        d(rid % 45 - 30).alias("d_left"),
        d(rid % 47 - 30).alias("d_right"),
        d(rid % 37).alias("d_center"),
        F.when(rid % 17 != 0, d(rid % 61)).otherwise(F.lit(float("nan"))).alias("a2sigpct"),
        d(rid % 59).alias("a4sigpct"),
        "nobs",
    )


@query(
    "b10_quality_flag",
    f"""WITH {QUALITY} SELECT row_id, CASE WHEN coalesce(rsq_detrend>=0 AND d_gap<=50 AND d_left>=-20 AND d_right>=-20
    AND d_center<=30 AND a2sigpct<=50 AND a4sigpct<=50 AND nobs>=5, false) THEN 0 ELSE 1 END AS qf_gauss_abs FROM q""",
    "fx_flux",
)
def b10(t: Inputs) -> DataFrame:
    return fl.flag_quality(quality_rows(t), CFG.quality).select("row_id", "qf_gauss_abs")


@query("b10_quality_flag_missing_column", "SELECT row_id, 1 AS qf_gauss_abs FROM fx_flux", "fx_flux")
def b10m(t: Inputs) -> DataFrame:
    return fl.flag_quality(quality_rows(t).drop("d_gap"), CFG.quality).select("row_id", "qf_gauss_abs")


CUT = "qf=0 AND nobs>=50 AND nobs<=9999 AND rsq_detrend>=0.6e0 AND rsq_detrend<=9999 AND flux>0"


@query("b11_post_cuts", f"SELECT row_id, flux FROM fx_flux WHERE {CUT}", "fx_flux")
def b11(t: Inputs) -> DataFrame:
    rows = t.flux.withColumn("t_emission", T.minus_hours("t_overpass", "age_hours"))
    return fl.apply_cuts(rows, "qf", (*CFG.cuts, ("absent", 0.0, 1.0)), "flux").select("row_id", "flux")


@query(
    "b12_age_and_quantile_trim",
    """WITH y AS (SELECT * FROM fx_flux WHERE age_hours<0.2e0), q AS (SELECT quantile_cont(flux,0.0) AS lo, quantile_cont(flux,0.98) AS hi FROM y)
    SELECT row_id, flux FROM y, q WHERE flux>=lo AND flux<=hi""",
    "fx_flux",
)
def b12(t: Inputs) -> DataFrame:
    return fl.age_and_quantile_trim(t.flux, "age_hours", "flux", CFG.age_max_hours, CFG.trim_quantiles).select("row_id", "flux")


@query(
    "b13_rank_flags",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY flux) - 1 AS k,
      count(*) OVER (PARTITION BY facility_id) AS n FROM fx_flux),
    l AS (SELECT facility_id, max(CASE WHEN k=CAST(floor(n*0.1e0) AS BIGINT) THEN flux END) AS lo,
      max(CASE WHEN k=(CAST(floor(n*0.9e0) AS BIGINT)-1+n)%n THEN flux END) AS hi FROM r GROUP BY 1)
    SELECT row_id, CASE WHEN nobs<20 OR nobs>180 THEN 1 ELSE 0 END AS qf_abs,
      CASE WHEN flux<lo OR flux>hi THEN 1 ELSE 0 END AS qf_pct FROM fx_flux JOIN l USING (facility_id)""",
    "fx_flux",
)
def b13(t: Inputs) -> DataFrame:
    flagged = fl.flag_absolute(t.flux, [("nobs", 20.0, 180.0), ("absent", 0.0, 1.0)])
    return fl.flag_rank_range(flagged, "flux", 0.1, 0.9, ["facility_id"]).select("row_id", "qf_abs", "qf_pct")


@query(
    "b13_rank_flags_global",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY flux) - 1 AS k, count(*) OVER () AS n FROM fx_flux),
    l AS (SELECT max(CASE WHEN k=CAST(floor(n*0.05e0) AS BIGINT) THEN flux END) AS lo,
      max(CASE WHEN k=CAST(floor(n*0.95e0) AS BIGINT)-1 THEN flux END) AS hi FROM r)
    SELECT row_id, CASE WHEN flux<lo OR flux>hi THEN 1 ELSE 0 END AS qf_pct FROM fx_flux, l""",
    "fx_flux",
)
def b13g(t: Inputs) -> DataFrame:
    return fl.flag_rank_range(t.flux, "flux", 0.05, 0.95).select("row_id", "qf_pct")


@query(
    "b14_positive_pairs",
    "SELECT event_id FROM events WHERE event_type<>'error' AND value>0 AND value-5e0>0",
)
def b14(t: Inputs) -> DataFrame:
    rows = t.events.select(
        "event_id",
        F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias("x"),
        (F.col("value") - 5.0).alias("y"),
    )
    return fl.positive_pairs(rows, "x", "y").select("event_id")


@query(
    "b15_unit_conversions",
    """SELECT scene,i,j, round(no2*1e-6*1e6,6) AS umol, round(no2*1e14/6.022e23*1e4*1e6,8) AS from_molec,
    round(no2*0.000453592e0,8) AS tonne FROM fx_pixel""",
    "fx_pixel",
)
def b15(t: Inputs) -> DataFrame:
    return t.pixel.select(
        "scene",
        "i",
        "j",
        F.round(chemistry.mol_to_umol(F.col("no2") * 1e-6), 6).alias("umol"),
        F.round(chemistry.molec_cm2_to_umol_m2(F.col("no2") * 1e14), 8).alias("from_molec"),
        F.round(chemistry.lb_to_tonne("no2"), 8).alias("tonne"),
    )


@query(
    "a06_filename_times",
    """SELECT row_id, epoch_us(date_trunc('second', t_overpass)) AS start_us,
    epoch_us(TIMESTAMP '2024-01-31 00:00:00') AS end_us, epoch_us(date_trunc('second', t_overpass)) AS granule_us FROM fx_flux""",
    "fx_flux",
)
def a06(t: Inputs) -> DataFrame:
    name = F.concat(F.lit("OCI."), F.date_format("t_overpass", "yyyyMMdd'T'HHmmss"), F.lit(".L2.nc"))
    return t.flux.select(
        "row_id",
        T.micros(T.overpass_time("source_file", "v1")).alias("start_us"),
        T.micros(T.overpass_time("source_file", "v1", token=9)).alias("end_us"),
        T.micros(T.granule_time(name)).alias("granule_us"),
    )


@query(
    "f01_row_pick",
    """SELECT facility_id, arg_max(row_id, flux*1e6 - row_id*1e-6) AS row_of_max,
    arg_min(row_id, abs(age_hours-0.5e0)*1e6 + row_id*1e-3) AS row_near_half FROM fx_flux GROUP BY 1""",
    "fx_flux",
)
def f01(t: Inputs) -> DataFrame:
    return t.flux.groupBy("facility_id").agg(
        F.max_by("row_id", F.struct("flux", -F.col("row_id"))).alias("row_of_max"),
        F.min_by("row_id", F.struct(F.round(F.abs(F.col("age_hours") - 0.5), 9), "row_id")).alias("row_near_half"),
    )


@query(
    "f02_ordered_sink",
    """SELECT facility_id, t_hour, round(tph, 8) AS tph FROM fx_hourly ORDER BY facility_id, t_hour""",
    "fx_hourly",
)
def f02(t: Inputs) -> DataFrame:
    hourly = ag.hourly_totals(t.cems, ["facility_id"], "t_hour", "nox_mass", "tph")
    return hourly.orderBy("facility_id", "t_hour").select(
        "facility_id", F.col("t_hour").cast("timestamp_ntz").alias("t_hour"), F.round("tph", 8).alias("tph")
    )


@query(
    "f03_every_nth",
    """SELECT overpass_id FROM (SELECT overpass_id, row_number() OVER (PARTITION BY facility_id ORDER BY t_start, overpass_id)-1 AS k
    FROM fx_overpass) r WHERE k%3=0""",
    "fx_overpass",
)
def f03(t: Inputs) -> DataFrame:
    from plumeflux.operators.trajectory import reindex

    ranked = reindex(t.overpass, ["facility_id"], ["t_start", "overpass_id"], T.day_index("t_start"))
    return ranked.where("idx % 3 = 0").select("overpass_id")


@query(
    "g01_union_promote",
    """SELECT row_id, flux, nobs, NULL::BIGINT AS extra FROM fx_flux WHERE qf=0
    UNION ALL SELECT row_id, flux, NULL, row_id*2 FROM fx_flux WHERE qf=1""",
    "fx_flux",
)
def g01(t: Inputs) -> DataFrame:
    good = t.flux.where("qf = 0").select("row_id", "flux", "nobs")
    bad = t.flux.where("qf = 1").select("row_id", "flux", (F.col("row_id") * 2).alias("extra"))
    return good.unionByName(bad, allowMissingColumns=True)
