"""Readers, resumable ingest and the end-to-end job on generated scenes."""

import datetime as dt
import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeflux.config import FluxConfig
from plumeflux.operators.filters import apply_cuts, keep_columns
from plumeflux.operators.joins import GridSpec
from plumeflux.plans import jobs
from plumeflux.sources import readers, sinks
from plumeflux.sources.requirements import missing_days, required_days
from plumeflux.streaming.incremental import failed_rows, incremental_ingest, read_ledger, run_batch

T0 = dt.datetime(2024, 1, 16, 18, 0)


def test_trajectory_file(spark, tmp_path):
    body = ["   2     1", "MET 1", "MET 2", "  1 FORWARD OMEGA", " 24 1 16 18 36.0 -95.0 10.0", " 1 PRESSURE"]
    rows = [f" 1 1 24 1 16 {18 + k // 4} {15 * (k % 4)} 0.0 {k * 0.25:.2f} {36 + 0.01 * k:.3f} {-95 + 0.05 * k:.3f} 10.0 990.1 280.{k}" for k in range(6)]
    (tmp_path / "tdump_sat_2167_plume_202401161800_v1").write_text("\n".join(body + rows) + "\n")
    got = readers.read_trajectories(spark, str(tmp_path)).orderBy("step_id").collect()
    assert len(got) == 6 and got[0]["facility_id"] == "2167" and got[0]["overpass_id"] == "202401161800"
    assert got[5]["tstmp"] == dt.datetime(2024, 1, 16, 19, 15) and got[5]["lat"] == pytest.approx(36.05)
    assert [r["step_id"] for r in got] == list(range(6)) and got[3]["temp"] == pytest.approx(280.3)


def test_flux_files_with_drifting_columns(spark, tmp_path):
    one, two = tmp_path / "2167_New_Plant", tmp_path / "6705_Other"
    one.mkdir(), two.mkdir()
    name = "csf_S5P_OFFL_L2__NO2____20240116T180000_20240116T190000_00001_03_020400_v1"
    (one / f"{name}.csv").write_text("step_id,age_hours,flux_no2,lon_a3_i\n0,0.25,1.5,9\n1,0.5,bad,9\n")
    (one / f"{name}_cems.csv").write_text("step_id,age_hours,flux_no2,lon_a3_i\n7,0.25,1.5,9\n")
    (two / f"{name}.csv").write_text("step_id,flux_no2,age_hours,extra\n0,2.5,1.0,4\n")
    got = readers.read_flux_rows(spark, str(tmp_path), version="v1").orderBy("facility_id", "step_id").collect()
    assert [(r["facility_id"], r["facility_name"], r["step_id"], r["flux_no2"], r["extra"]) for r in got] == [
        ("2167", "New_Plant", 0.0, 1.5, None),
        ("2167", "New_Plant", 1.0, None, None),
        ("6705", "Other", 0.0, 2.5, 4.0),
    ]
    assert "lon_a3_i" not in got[0].asDict() and got[2]["t_emission"] == dt.datetime(2024, 1, 16, 17, 0)
    end = readers.read_flux_rows(spark, str(tmp_path), version="v1", overpass_token=9).first()
    assert end["t_overpass"] == dt.datetime(2024, 1, 16, 19, 0)


def test_facility_and_monitor_sources(spark, tmp_path):
    (tmp_path / "f.csv").write_text("facilityId,facilityName,state,latitude,longitude,primaryFuel,tz\n2167,New Plant,MO,36.5,-89.6,Coal,America/Chicago\n9,Nine,AZ,33,-112,Gas,\n")
    fac = readers.read_facilities(spark, str(tmp_path / "f.csv"), ids=[2167, 5])
    assert [tuple(r)[:2] for r in fac.select("facility_id", "lat").collect()] == [("2167", 36.5)]
    rows = [("2167", 2024, 1, "u1", dt.date(2024, 1, 16), 10, 5.0), ("2167", 2024, 2, "u1", dt.date(2024, 2, 16), 10, 5.0)]
    cems = spark.createDataFrame(rows, "facility_id string, year int, month int, unit_id string, date date, hour int, noxMass double")
    sinks.write_parquet(cems, str(tmp_path / "cems"), ["facility_id", "year", "month"])
    asks = spark.createDataFrame([("2167", dt.datetime(2024, 1, 31, 23, 50))], "facility_id string, t timestamp")
    months = readers.needed_months(asks, "t", 0.5)
    assert {(r["year"], r["month"]) for r in months.collect()} == {(2024, 1), (2024, 2)}
    one = readers.read_cems(spark, str(tmp_path / "cems"), months.where("month = 1"))
    hour = readers.with_utc_hour(one.withColumn("facility_id", F.col("facility_id").cast("string")), fac).first()
    assert hour["tstmp_utc"] == dt.datetime(2024, 1, 16, 16, 0)


def test_swath_rings_and_projection(spark):
    g = spark.createDataFrame(
        [("g", [T0, T0 + dt.timedelta(seconds=1)], [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])], "granule_id string, scan_time array<timestamp>, no2 array<array<double>>"
    )
    px = readers.explode_swath(g, ["no2"]).orderBy("i", "j").collect()
    assert [(r["i"], r["j"], r["no2"]) for r in px][3] == (1, 0, 4.0) and px[5]["t_utc"] == T0 + dt.timedelta(seconds=1)
    b = spark.createDataFrame([([0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 1.0]), ([0.0, float("nan"), 1.0, 0.0], [0.0] * 4)], "lat_bounds array<double>, lon_bounds array<double>")
    lat, lon = readers.pixel_ring()
    rings = b.select(lat.alias("a"), lon.alias("o")).collect()
    assert rings[0]["a"] == [0.0, 1.0, 1.0, 0.0, 0.0] and rings[1]["a"] is None and rings[1]["o"] is None
    assert keep_columns(b, ["nothing"]).columns == b.columns


def test_missing_flux_column_is_a_clear_error(spark):
    with pytest.raises(ValueError, match="flux_nox_fit"):
        apply_cuts(spark.createDataFrame([(1,)], "qf int"), "qf", [], "flux_nox_fit")


def test_required_days(spark):
    o = spark.createDataFrame([(1, dt.datetime(2024, 1, 16, 17, 30)), (2, dt.datetime(2024, 1, 16, 1, 0))], "id int, t timestamp")
    need = required_days(o, "t")
    assert {(r["id"], str(r["day"])) for r in need.collect()} == {(1, "2024-01-16"), (1, "2024-01-17"), (2, "2024-01-15"), (2, "2024-01-16")}
    bg = required_days(o.where("id = 1"), "t", mode="bg").orderBy("day_order").collect()
    assert [str(r["day"]) for r in bg] == ["2024-01-17", "2024-01-16"] and bg[0]["run_hours"] == 8
    have = spark.createDataFrame([(dt.date(2024, 1, 16),)], "day date")
    assert {str(r["day"]) for r in missing_days(need, have).collect()} == {"2024-01-15", "2024-01-17"}


def second_sensor(spark, names):
    rows = [(n, i, j, 36 + 0.1 * i, -95 + 0.1 * j, T0 + dt.timedelta(hours=k)) for k, n in enumerate(names) for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "granule_id string, i long, j long, lat double, lon double, t_granule timestamp")


def test_ingest_resumes_and_reports(spark, tmp_path):
    over = spark.createDataFrame([("f", "file", T0, T0 + dt.timedelta(minutes=2))], "facility_id string, file string, time_utc_i timestamp, time_utc_f timestamp")
    fac = spark.createDataFrame([("f", 36.0, -95.0)], "facility_id string, lat double, lon double")
    seen = []

    def process(px):
        seen.append({r["granule_id"] for r in px.select("granule_id").distinct().collect()})
        return jobs.colocate_sensors(px, over, fac, 0.25)

    ledger = str(tmp_path / "ledger")
    report = run_batch(second_sensor(spark, ["a", "b"]), ledger, process).first()
    assert (report["total"], report["overlap"], report["errors"]) == (2, 2, 0)
    sinks.write_parquet(spark.createDataFrame([], "x int"), str(tmp_path / "other"))
    run_batch(second_sensor(spark, ["a", "b", "c"]), ledger, process)
    assert seen == [{"a", "b"}, {"c"}]
    rows = {r["granule_id"]: r for r in read_ledger(spark, ledger).collect()}
    assert rows["b"]["dt_min"] == pytest.approx(59.0) and rows["a"]["n_pts"] == 9
    bad = failed_rows(spark.createDataFrame([("z",)], "granule_id string"), "download_failed").first()
    assert bad["status"] == "download_failed" and bad["overlap"] is False


def test_streaming_ingest_runs_each_file_once(spark, tmp_path):
    src, ledger, ckpt = (str(tmp_path / n) for n in ("src", "ledger", "ckpt"))
    over = spark.createDataFrame([("f", "file", T0, T0)], "facility_id string, file string, time_utc_i timestamp, time_utc_f timestamp")
    fac = spark.createDataFrame([("f", 36.0, -95.0)], "facility_id string, lat double, lon double")
    for n in ("a", "b"):
        px = second_sensor(spark, [n])
        px.write.mode("append").parquet(src)
        q = incremental_ingest(spark, src, px.schema, ledger, ckpt, lambda d: jobs.colocate_sensors(d, over, fac, 0.25))
        assert q.awaitTermination(120) and q.exception() is None
    assert sorted(r["granule_id"] for r in read_ledger(spark, ledger).collect()) == ["a", "b"]


FWHM = 18.0


def plume_scene(spark, tilt=0.0):
    rows = []
    for i in range(60):
        for j in range(90):
            lat, lon = 34.5 + 0.05 * i, -96 + 0.05 * j
            ridge = 36.0 + tilt * max(lon + 95.0, 0.0)
            d = (lat - ridge) * 111.19 * np.cos(np.arctan(tilt))
            here = 60.0 * np.exp(-4 * np.log(2) * (d / FWHM) ** 2) * (lon > -95.2)
            rows.append(("f", "o", i, j, float(20.0 + here + 0.05 * ((i * 7 + j * 3) % 5)), 0.5, 1.0, lat, lon))
    return spark.createDataFrame(rows, "facility_id string, overpass_id string, i long, j long, no2 double, no2_sigma double, qa double, lat double, lon double")


def wind_path(spark, tilt=0.0, n=24):
    rows = [("f", "o", k, T0 + dt.timedelta(minutes=15 * k), 36.0 + tilt * 0.1 * k, -95.0 + 0.1 * k, 0.25 * k, T0) for k in range(n)]
    return spark.createDataFrame(rows, "facility_id string, overpass_id string, step_id long, tstmp timestamp, lat double, lon double, age_hours double, t_overpass timestamp")


def fields(spark):
    rows = [(T0.replace(hour=h, minute=m), float(a), float(o), 3e-8, 0.5, 285.0, 1e5, 2e-13) for h in range(6, 19) for m in (0, 30) for a in range(30, 42) for o in range(-100, -85)]
    return spark.createDataFrame(rows, "valid_time timestamp, lat double, lon double, o3 double, cosz double, t_k double, ps double, oh double")


SPEC = GridSpec(30.0, 1.0, 12, -100.0, 1.0, 15)
# the plume covers about a tenth of the scene, so the mask takes the top tenth
CFG = replace(FluxConfig(), decay_option="B", snr_quantile=0.9)


def run(spark, cfg, tilt=0.0, path_tilt=0.0, pixels=None):
    inp = jobs.PipelineInputs(
        pixels=plume_scene(spark, tilt) if pixels is None else pixels,
        trajectory=wind_path(spark, path_tilt),
        fields=fields(spark),
        grid=SPEC,
        oh_fields=fields(spark),
        facilities=spark.createDataFrame([("f", 36.0, -95.0)], "facility_id string, lat double, lon double"),
    )
    rows, result = jobs.flux_pipeline(inp, cfg)
    return rows.toPandas(), result.toPandas()


def test_straight_plume_end_to_end(spark):
    rows, result = run(spark, CFG)
    first = rows[rows["traj"] == "H"].set_index("step_id").sort_index().loc[3:18]
    assert (first["fit_status"] == "ok").all() and (first["qf_gauss_abs"] == 0).all()
    assert first["a3"].abs().max() < 1.0 and (first["a4"] - FWHM).abs().max() < 3.0
    wind = 0.1 * 111190 * np.cos(np.radians(36)) / 900
    assert np.allclose(first["wso"].astype(float), wind, rtol=1e-2)
    area = 0.5 * np.sqrt(np.pi / np.log(2)) * (first["a2"] / 1e6 * 46.0055 / 1e6) * (first["a4"] * 1e3) * first["wso"] * 3600
    assert np.allclose(first["flux_no2"], area)
    true = 0.5 * np.sqrt(np.pi / np.log(2)) * (60 / 1e6 * 46.0055 / 1e6) * (FWHM * 1e3) * wind * 3600
    assert np.allclose(first["flux_no2"], true, rtol=0.1)
    second = rows[rows["traj"] == "O"]
    assert len(second) > 5 and (second["lat_tdump"] - 36.0).abs().max() < 0.1 and second["time_tag"].notna().all()
    got = result.iloc[0]
    assert got["status"] == "ok" and got["pss_ratio"] > 1 and got["flux_nox_source"] >= got["flux_nox_pss"] > 0


def test_second_pass_finds_a_turned_plume(spark):
    rows, _ = run(spark, CFG, tilt=0.25)
    second = rows[rows["traj"] == "O"]
    ridge = 36.0 + 0.25 * np.maximum(second["lon_tdump"] + 95.0, 0.0)
    assert len(second) > 5 and (second["lat_tdump"] - ridge).abs().max() < 0.12


@pytest.mark.parametrize("method", ["a3", "moore", "greedy"])
def test_other_path_methods(spark, method):
    rows, result = run(spark, replace(CFG, path_method=method, decay_option="A"))
    assert (rows["traj"] == "O").sum() > 2 and len(result) == 1


def test_no_plume_keeps_first_pass_rows(spark):
    flat = plume_scene(spark).withColumn("no2", F.lit(20.0) + (F.col("i") % 2) * 0.1)
    rows, result = run(spark, CFG, pixels=flat)
    assert (rows["traj"] == "H").any() and result.iloc[0]["status"] in ("no_good_transect", "no_second_pass", "no_pss_point")


def test_empty_scene_gives_no_rows(spark):
    rows, result = run(spark, CFG, pixels=plume_scene(spark).where("i < 0"))
    assert len(rows) == 0 and len(result) == 0


def test_written_clip_is_float32_and_partitioned(spark, tmp_path):
    px = plume_scene(spark).limit(50).withColumn("granule_id", F.lit("g"))
    sinks.write_clipped(px, str(tmp_path / "clip"), ["no2", "lat", "lon", "absent"])
    back = spark.read.parquet(str(tmp_path / "clip"))
    assert dict(back.dtypes)["no2"] == "float" and back.count() == 50 and os.path.isdir(tmp_path / "clip" / "facility_id=f")
