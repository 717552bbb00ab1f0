"""The match job from flux files and monthly monitor files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumeflux.config import FluxConfig
from plumeflux.plans import jobs
from plumeflux.sources import readers

NAME = "csf_S5P_OFFL_L2__NO2____{t}_{t}_00001_03_020400_v1.csv"
ZONES = [("2167", "America/Chicago"), ("6705", None)]


@pytest.fixture
def files(tmp_path):
    flux, monitor = tmp_path / "flux", tmp_path / "monitor"
    for folder in ("2167_New_Plant", "6705_Other"):
        (flux / folder).mkdir(parents=True)
        (monitor / folder).mkdir(parents=True)
    # emission at 18:00 UTC in January, and at 00:30 UTC on 1 February: still January in Chicago
    (flux / "2167_New_Plant" / NAME.format(t="20240116T180600")).write_text("step_id,age_hours,flux_nox_fit,qf_gauss_abs\n0,0.1,2.5,0\n1,0.1,9.0,1\n")
    (flux / "2167_New_Plant" / NAME.format(t="20240201T003600")).write_text("flux_nox_fit,step_id,qf_gauss_abs,age_hours\n3.5,0,0,0.1\n")
    (flux / "6705_Other" / NAME.format(t="20240310T120600")).write_text("step_id,flux_nox_fit,age_hours,qf_gauss_abs\n0,4.5,0.1,0\n")
    (flux / "6705_Other" / NAME.format(t="20240311T120600")).write_text("no header here\n1,2,3\n")
    (flux / "6705_Other" / NAME.format(t="20240312T120600")).write_text("")
    hours = {"2167_New_Plant": [("2024-01-16", 12, 1000), ("2024-01-16", 12, 500), ("2024-01-31", 18, 2000), ("2024-01-31", 19, 7)], "6705_Other": [("2024-03-10", 12, 3000), ("2024-03-10", 13, "n/a")]}
    for folder, rows in hours.items():
        for month in range(1, 13):
            mine = [f"{d},{h},{m}" for d, h, m in rows if int(d[5:7]) == month]
            head, rest = ("date,hour,noxMass", mine) if month != 3 else ('"noxMass","unit","date","hour"', [f"{m},u1,{d},{h}" for d, h, m in (x.split(",") for x in mine)])
            (monitor / folder / f"{folder}_2024_{month:02d}.csv").write_text("\n".join([head, *rest]) + "\n")
    (monitor / "6705_Other" / "6705_Other_2024_04.csv").write_text("broken")
    return str(flux), str(monitor)


def test_match_from_files(spark, files):
    facilities = spark.createDataFrame(ZONES, "facility_id string, tz string")
    cfg = FluxConfig(trim_quantiles=(0.0, 1.0))
    got = jobs.match_from_files(spark, *files, facilities, cfg, version="v1").orderBy("facility_id", "t_emission").collect()
    tonnes = [(r.facility_id, r.flux_nox_fit, r.t_emission, round(r.cems_nox_tph / 0.000453592, 6)) for r in got]
    assert tonnes == [
        ("2167", 2.5, dt.datetime(2024, 1, 16, 18, 0), 1500.0),
        ("2167", 3.5, dt.datetime(2024, 2, 1, 0, 30), pytest.approx(2000.0)),
        ("6705", 4.5, dt.datetime(2024, 3, 10, 12, 0), 3000.0),
    ]


def test_bad_flux_files_are_reported_not_fatal(spark, files):
    report = {(r.file.rsplit("_T", 1)[-1].split("____")[1][:8], r.status): r.n_rows for r in readers.flux_file_report(spark, files[0]).collect()}
    assert report == {("20240116", "ok"): 2, ("20240201", "ok"): 1, ("20240310", "ok"): 1, ("20240311", "no_header"): 2}
    with pytest.raises(ValueError, match="20240311"):
        readers.read_flux_rows(spark, files[0], version="v1")
    rows = readers.read_flux_rows(spark, files[0], version="v1", on_bad="skip")
    assert rows.count() == 4 and rows.where("flux_nox_fit IS NULL").count() == 0


def test_only_needed_months_are_scanned(spark, files):
    months = spark.createDataFrame([("2167", 2024, 1), ("2167", 2024, 2), ("6705", 2024, 3)], "facility_id string, year int, month int")
    rows = readers.read_cems_csv(spark, files[1], months)
    names = {f.rsplit("/", 1)[1] for f in rows.inputFiles()}
    assert names == {f"{p}_2024_{m:02d}.csv" for p in ("2167_New_Plant", "6705_Other") for m in (1, 2, 3)}
    assert rows.groupBy("facility_id").count().orderBy("facility_id").collect() == [("2167", 4), ("6705", 2)]
    assert {(r.facility_name, r.year, r.month) for r in rows.select("facility_name", "year", "month").distinct().collect()} == {("New_Plant", 2024, 1), ("Other", 2024, 3)}
    none = readers.read_cems_csv(spark, files[1], months.limit(0))
    assert none.count() == 0 and {"date", "hour", "noxMass", "facility_id"} <= set(none.columns)
    assert readers.read_cems_csv(spark, files[1]).where(F.col("noxMass") == "n/a").count() == 1
