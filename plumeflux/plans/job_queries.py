"""Registered queries for chemistry, composite jobs and ingest."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeflux.config import FluxConfig
from plumeflux.fixtures import Inputs
from plumeflux.functions import chemistry as ch
from plumeflux.functions import timeconv as T
from plumeflux.operators import nox as nx
from plumeflux.plans import jobs
from plumeflux.plans.join_queries import KEY, SPEC, good_pixels, hourly, scene_traj
from plumeflux.plans.registry import query
from plumeflux.streaming.incremental import not_yet_done

CFG = FluxConfig()

CHEM = """g AS (SELECT *, 300e0+(row_id%40) AS tk, 0.9e0*((row_id%21)-3)/20e0 AS cz, CASE WHEN row_id%7=0 THEN NULL ELSE 90000e0+row_id%11000 END AS pp,
 CASE WHEN row_id%13=0 THEN 0e0 ELSE 3e-8+1e-10*(row_id%50) END AS o3 FROM fx_flux),
 c AS (SELECT *, 8.5e-3*power(greatest(0e0,cz),0.7e0) AS j, 3e-12*exp(-1500e0/tk) AS k, coalesce(pp,101325e0)/(1.380649e-23*tk)*1e-6 AS air FROM g),
 r AS (SELECT *, CASE WHEN k*o3*air>0 THEN 1+j/(k*o3*air) END AS ratio FROM c)"""


def chem_rows(t: Inputs) -> DataFrame:
    rid = F.col("row_id")
    return t.flux.withColumns(
        {
            "tk": 300.0 + rid % 40,
            "cz": 0.9 * ((rid % 21) - 3) / 20.0,
            "pp": F.when(rid % 7 != 0, 90000.0 + rid % 11000),
            "o3": F.when(rid % 13 == 0, F.lit(0.0)).otherwise(3e-8 + 1e-10 * (rid % 50)),
        }
    )


@query(
    "h10_photostationary_ratio",
    f"WITH {CHEM} SELECT row_id, round(j*1e3,8) AS j_milli, round(k*1e15,8) AS k_femto, round(ratio,8) AS ratio FROM r",
    "fx_flux",
)
def h10(t: Inputs) -> DataFrame:
    rows = chem_rows(t).withColumns(
        {"j": ch.j_no2("cz"), "k": ch.k_no_o3("tk"), "nd": F.col("o3") * ch.air_density("pp", "tk")}
    )
    return rows.select(
        "row_id",
        F.round(F.col("j") * 1e3, 8).alias("j_milli"),
        F.round(F.col("k") * 1e15, 8).alias("k_femto"),
        F.round(ch.pss_ratio("j", "k", "nd"), 8).alias("ratio"),
    )


@query(
    "h11_nox_flux",
    """WITH r AS (SELECT row_id, flux, 1+rsq_detrend AS q FROM fx_flux)
    SELECT row_id, round(flux*q*(((q-1)/q)*30.0061e0+(1-(q-1)/q)*46.0055e0)/46.0055e0,6) AS effective, round(flux*q,6) AS plain FROM r""",
    "fx_flux",
)
def h11(t: Inputs) -> DataFrame:
    rows = t.flux.withColumn("q", 1 + F.col("rsq_detrend"))
    return rows.select(
        "row_id",
        F.round(ch.nox_flux("flux", "q"), 6).alias("effective"),
        F.round(ch.nox_flux("flux", "q", effective_mw=False), 6).alias("plain"),
    )


@query(
    "h12_loss_rate",
    """WITH g AS (SELECT row_id, coalesce(CASE WHEN row_id%3=0 THEN NULL ELSE 270e0+row_id%40 END, CASE WHEN row_id%2=0 THEN 280e0+row_id%20 END, 298e0) AS tk, 1e6+row_id AS oh FROM fx_flux),
    k AS (SELECT *, 2.4e-30*power(tk/300e0,-3e0)*2.5e19 AS lo, 1.7e-11*power(tk/300e0,-2.1e0) AS hi FROM g)
    SELECT row_id, round(lo/(1+lo/hi)*power(0.6e0,1/(1+power(log10(lo/hi),2)))*oh*1e6,8) AS k_micro FROM k""",
    "fx_flux",
)
def h12(t: Inputs) -> DataFrame:
    rid = F.col("row_id")
    temp = ch.loss_temperature(F.when(rid % 3 != 0, 270.0 + rid % 40), F.when(rid % 2 == 0, 280.0 + rid % 20))
    return t.flux.select(rid, F.round(ch.k_loss(temp, 1e6 + rid) * 1e6, 8).alias("k_micro"))


@query(
    "h14_facility_slug",
    "SELECT c_custkey, CAST(c_custkey AS VARCHAR) || '_' || replace(c_name,' ','_') AS slug FROM customer",
)
def h14(t: Inputs) -> DataFrame:
    return t.table("customer").select("c_custkey", T.facility_slug("c_custkey", "c_name").alias("slug"))


@query(
    "a07_field_times",
    """SELECT o_orderkey, CASE WHEN (s>=TIMESTAMP '2023-01-01 00:00:00' AND s<=TIMESTAMP '2024-10-31 23:59:59') OR s>=TIMESTAMP '2025-08-01 00:00:00'
      THEN epoch_us(date_trunc('hour',s))+1800000000 END AS tavg_us,
    CASE WHEN (s>=TIMESTAMP '2023-01-01 00:00:00' AND s<=TIMESTAMP '2024-10-31 23:59:59') OR s>=TIMESTAMP '2025-08-01 00:00:00'
      THEN epoch_us(date_trunc('hour',s)) END AS inst_us
    FROM (SELECT o_orderkey, o_orderdate + to_days(9000) + to_minutes(CAST(o_orderkey%1440 AS BIGINT)) AS s FROM orders) q""",
)
def a07(t: Inputs) -> DataFrame:
    when = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(days=F.lit(9000), mins=(F.col("o_orderkey") % 1440).cast("int"))
    rows = t.table("orders").select("o_orderkey", when.alias("s"))
    return rows.select(
        "o_orderkey", T.micros(nx.field_time("s")).alias("tavg_us"), T.micros(nx.field_time("s", "inst")).alias("inst_us")
    )


@query(
    "a02_explode_swath",
    """SELECT vec_id, epoch_us(TIMESTAMP '2024-01-01 00:00:00')+vec_id*1000000 AS t_us, unnest(range(len(embedding))) AS j,
    round(CAST(unnest(embedding) AS DOUBLE)*1e6,3) AS v FROM embeddings""",
)
def a02(t: Inputs) -> DataFrame:
    from plumeflux.sources.readers import explode_swath

    granules = t.table("embeddings").select(
        F.col("vec_id").alias("granule_id"),
        F.array(F.timestamp_micros(F.lit(1704067200000000) + F.col("vec_id") * 1000000)).alias("scan_time"),
        F.array("embedding").alias("no2"),
    )
    px = explode_swath(granules, ["no2"])
    return px.select(
        F.col("granule_id").alias("vec_id"),
        T.micros("t_utc").alias("t_us"),
        F.col("j").cast("bigint").alias("j"),
        F.round(ch.mol_to_umol(F.col("no2").cast("double")), 3).alias("v"),
    )


@query(
    "a11_pending_items",
    "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type IN ('view','error'))",
)
def a11(t: Inputs) -> DataFrame:
    ledger = t.events.where("event_type IN ('view', 'error')").select("event_id")
    return not_yet_done(t.events.select("event_id"), ledger, "event_id")


def granules(t: Inputs) -> DataFrame:
    return t.pixel.withColumn("granule_id", F.col("scene")).withColumn(
        "t_utc", T.from_micros(F.lit(1704067200000000) + F.col("scene") * 3600000000 + F.col("i") * 1000000)
    )


@query(
    "k01_clip_granules",
    """WITH h AS (SELECT facility_id, scene AS granule_id, min(i) AS i0, max(i)+1 AS i1, min(j) AS j0, max(j)+1 AS j1 FROM fx_pixel p JOIN fx_facility f
      ON p.lat>f.lat-2e0 AND p.lat<f.lat+2e0 AND p.lon>f.lon-2e0 AND p.lon<f.lon+2e0 GROUP BY 1,2)
    SELECT facility_id, granule_id, count(*) AS n_data, min(i) AS scanline_i0, max(i)+1 AS scanline_i1, min(j) AS pixel_j0, max(j)+1 AS pixel_j1,
      round(min(lat),6) AS latmin, round(max(lon),6) AS lonmax, epoch_us(TIMESTAMP '2024-01-01 00:00:00')+granule_id*3600000000+min(i)*1000000 AS ti
    FROM fx_pixel p JOIN h ON p.scene=h.granule_id AND i>=i0 AND i<i1 AND j>=j0 AND j<j1 GROUP BY 1,2""",
    "fx_pixel fx_facility",
)
def k01(t: Inputs) -> DataFrame:
    px = granules(t)
    overpass, _ = jobs.clip_granules(px, jobs.granule_extents(px), t.facility, CFG)
    return overpass.select(
        "facility_id",
        "granule_id",
        "n_data",
        *["scanline_i0", "scanline_i1", "pixel_j0", "pixel_j1"],
        F.round("latmin", 6).alias("latmin"),
        F.round("lonmax", 6).alias("lonmax"),
        T.micros("time_utc_i").alias("ti"),
    )


def fixture_traj(t: Inputs) -> DataFrame:
    """Trajectories in domain form, keyed by facility and scene."""
    return scene_traj(t).withColumns(
        {"t_overpass": F.expr("TIMESTAMP '2024-02-01 12:00:00'"), "age_hours": F.col("step_id") * 0.25}
    )


PATH = ["facility_id", "scene"]


@query("k02_cross_sectional_flux")
def k02(t: Inputs) -> DataFrame:
    from plumeflux.operators.trajectory import with_kinematics
    from plumeflux.session import cut_lineage

    traj = cut_lineage(with_kinematics(fixture_traj(t), PATH))
    rows = jobs.cross_sectional_flux(good_pixels(t), traj, PATH, ["scene"], CFG)
    return rows.select(
        *PATH, "step_id", "fit_status", "qf_gauss_abs", "nobs", *[F.round(c, 3).alias(c) for c in ("a2", "a3", "a4", "flux_no2", "wd_std")]
    )


def chem_fields(t: Inputs) -> DataFrame:
    return t.grid.withColumns({"cosz": F.lit(0.5), "ps": F.lit(None).cast("double"), "oh": F.lit(1e-13)})


def flux_path(t: Inputs) -> DataFrame:
    """One flux row per facility and age: the fixture's flux rows averaged per age step."""
    per = t.flux.groupBy("facility_id", F.round(F.col("age_hours") * 100).cast("bigint").alias("step_id")).agg(
        F.avg("flux").alias("flux_no2"), F.min("qf").alias("qf_gauss_abs"), F.min("t_overpass").alias("t0")
    )
    return per.join(t.facility.select("facility_id", F.col("lat").alias("lat_a3"), F.col("lon").alias("lon_a3")), "facility_id").withColumns(
        {
            "age_hours": (F.col("step_id") + 1) * 0.05,
            "time_tag": F.col("t0"),
            "vt": F.date_trunc("day", "t0"),
        }
    )


@query("i02_pss_point")
def i02(t: Inputs) -> DataFrame:
    found = nx.find_pss_point(flux_path(t), KEY, CFG.residual_tol)
    return found.select("facility_id", "pss_step_id", "fit_ok", F.round("t_peak", 4).alias("t_peak"))


def _nox(t: Inputs, option: str) -> DataFrame:
    _, result = nx.nox_workflow(
        flux_path(t), KEY, chem_fields(t), SPEC, option, CFG.residual_tol, oh_fields=chem_fields(t), time_key="vt", oh_time_key="vt"
    )
    cols = ("pss_ratio", "flux_nox_pss", "flux_nox_source", "age_at_pss_s")
    return result.select("facility_id", "status", "pss_step_id", *[F.round(c, 4).alias(c) for c in cols])


@query("i03_decay_empirical")
def i03(t: Inputs) -> DataFrame:
    return _nox(t, "A")


@query("i04_decay_amplitude_lifetime")
def i04(t: Inputs) -> DataFrame:
    return _nox(t, "A_total")


@query("i05_k04_nox_workflow_analytic")
def i05(t: Inputs) -> DataFrame:
    return _nox(t, "B")


def matched(t: Inputs) -> DataFrame:
    rows = t.flux.withColumn("t_emission", T.minus_hours("t_overpass", "age_hours"))
    return jobs.match_emissions(rows, hourly(t, "cems_nox_tph"), CFG, "flux", "qf", hour="t_hour")


MATCH = """c AS (SELECT * FROM fx_flux WHERE qf=0 AND nobs>=50 AND nobs<=9999 AND rsq_detrend>=0.6e0 AND rsq_detrend<=9999 AND flux>0 AND age_hours<0.2e0),
 lim AS (SELECT quantile_cont(flux,0.0) AS lo, quantile_cont(flux,0.98) AS hi FROM c),
 em AS (SELECT row_id, facility_id, flux, age_hours, epoch_us(t_overpass) - CAST(round(age_hours*3600000000e0) AS BIGINT) AS te FROM c, lim WHERE flux>=lo AND flux<=hi),
 cand AS (SELECT row_id, tph, epoch_us(h.t_hour) AS th, row_number() OVER (PARTITION BY row_id ORDER BY abs(te-epoch_us(h.t_hour)), h.t_hour) AS rn
  FROM em JOIN fx_hourly h USING (facility_id) WHERE abs(te-epoch_us(h.t_hour))<=1800000000),
 matched AS (SELECT em.*, tph, th FROM em LEFT JOIN (SELECT * FROM cand WHERE rn=1) USING (row_id))"""


@query(
    "k05_match_emissions",
    f"WITH {MATCH} SELECT row_id, facility_id, flux, round(tph,9) AS cems_nox_tph, th AS cems_us FROM matched",
    "fx_flux fx_hourly",
)
def k05(t: Inputs) -> DataFrame:
    return matched(t).select(
        "row_id", "facility_id", "flux", F.round("cems_nox_tph", 9).alias("cems_nox_tph"), T.micros("cems_t_emit").alias("cems_us")
    )


@query(
    "k06_colocate_sensors",
    """WITH h AS (SELECT scene AS granule_id, facility_id, count(*) AS n_pts, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM fx_pixel p JOIN fx_facility f
      ON p.lat>f.lat-3e0 AND p.lat<f.lat+3e0 AND p.lon>f.lon-3e0 AND p.lon<f.lon+3e0 GROUP BY 1,2),
    b AS (SELECT h.granule_id, h.facility_id, n_pts, min(lat) AS latmin, max(lon) AS lonmax FROM h JOIN fx_pixel p ON p.scene=h.granule_id AND i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1 GROUP BY 1,2,3),
    g AS (SELECT DISTINCT scene AS granule_id, epoch_us(TIMESTAMP '2024-01-05 00:00:00')+scene*7200000000 AS tg FROM fx_pixel),
    m AS (SELECT b.granule_id, b.facility_id, overpass_id, tg-(epoch_us(t_start)+50000000) AS dt,
      row_number() OVER (PARTITION BY b.granule_id, b.facility_id ORDER BY abs(tg-(epoch_us(t_start)+50000000)), overpass_id) AS rn
      FROM b JOIN g USING (granule_id) JOIN fx_overpass o ON o.facility_id=b.facility_id)
    SELECT g.granule_id, b.facility_id, b.facility_id IS NOT NULL AS overlap, coalesce(n_pts,0) AS n_pts, round(latmin,6) AS latmin, round(lonmax,6) AS lonmax,
      m.overpass_id AS file, round(dt/1000000e0,6) AS dt_sec
    FROM g LEFT JOIN b USING (granule_id) LEFT JOIN (SELECT * FROM m WHERE rn=1) m ON m.granule_id=b.granule_id AND m.facility_id=b.facility_id""",
    "fx_pixel fx_facility fx_overpass",
)
def k06(t: Inputs) -> DataFrame:
    px = t.pixel.select(
        F.col("scene").alias("granule_id"),
        *["i", "j", "lat", "lon"],
        T.from_micros(F.lit(1704412800000000) + F.col("scene") * 7200000000).alias("t_granule"),
    )
    over = t.overpass.select(
        "facility_id", F.col("overpass_id").alias("file"), F.col("t_start").alias("time_utc_i"), F.col("t_end").alias("time_utc_f")
    )
    rows = jobs.colocate_sensors(px, over, t.facility, CFG.second_sensor_buffer_deg)
    return rows.select(
        "granule_id",
        "facility_id",
        "overlap",
        "n_pts",
        F.round("latmin", 6).alias("latmin"),
        F.round("lonmax", 6).alias("lonmax"),
        F.col("trop_file").alias("file"),
        F.round(F.col("dt_min") * 60.0, 6).alias("dt_sec"),
    )


@query(
    "k07_compare_summary",
    f"""WITH {MATCH}, p AS (SELECT * FROM matched WHERE tph>0 AND flux>0)
    SELECT facility_id, count(*) AS n, round(CASE WHEN count(*)>=3 AND var_pop(tph)>0 THEN regr_slope(flux,tph) END,4) AS slope,
    round(CASE WHEN count(*)>=3 AND var_pop(tph)>0 AND var_pop(flux)>0 THEN corr(flux,tph) END,6) AS r, round(quantile_cont(age_hours,0.95),6) AS age_p95
    FROM p GROUP BY 1""",
    "fx_flux fx_hourly",
)
def k07(t: Inputs) -> DataFrame:
    s = jobs.compare_summary(matched(t), KEY, "cems_nox_tph", "flux")
    return s.select("facility_id", "n", F.round("slope", 4).alias("slope"), F.round("r", 6).alias("r"), F.round("age_p95", 6).alias("age_p95"))


def pipeline(t: Inputs, method: str = "combined", option: str = "B") -> tuple[DataFrame, DataFrame]:
    """All days of the fields, each for its 24 hours; a path's overpass is its own last time, so its clock runs within those days."""
    cfg = replace(CFG, path_method=method, decay_option=option)
    fields = t.grid.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumns(
        {"cosz": F.lit(0.5), "ps": F.lit(None).cast("double"), "oh": F.lit(1e-13)}
    )
    base = T.micros("valid_time") + F.col("h") * T.HOUR_US
    last = t.trajectory.groupBy(*KEY).agg(F.max("tstmp").alias("t_overpass"))
    mid = fields.withColumn("valid_time", T.from_micros(base + T.HOUR_US // 2)).drop("h")
    top = fields.withColumn("valid_time", T.from_micros(base)).drop("h")
    inp = jobs.PipelineInputs(
        pixels=t.pixel,
        trajectory=fixture_traj(t).drop("t_overpass").join(last, KEY),
        fields=mid,
        grid=SPEC,
        keys=("facility_id", "scene"),
        pixel_keys=("scene",),
        oh_fields=top,
        facilities=t.facility,
    )
    return jobs.flux_pipeline(inp, cfg)


@query("k08_flux_pipeline")
def k08(t: Inputs) -> DataFrame:
    _, result = pipeline(t)
    cols = ("pss_ratio", "flux_nox_pss", "flux_nox_source", "k_loss")
    return result.select(*PATH, "status", "pss_step_id", *[F.round(c, 4).alias(c) for c in cols])
