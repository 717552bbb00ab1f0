"""Registered round trips through the package's sinks and readers, on files derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeflux.fixtures import Inputs
from plumeflux.functions import timeconv as T
from plumeflux.plans.registry import query
from plumeflux.session import ensure_checkpoint_dir
from plumeflux.sources import readers, sinks


def folder(spark: SparkSession) -> str:
    """A new folder beside the tables of the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"


@query(
    "a01_facility_csv",
    "SELECT CAST(facility_id AS VARCHAR) AS facility_id, lat, lon, tz FROM fx_facility WHERE facility_id IN (SELECT user_id FROM events WHERE event_type='purchase')",
    "fx_facility",
)
def a01(t: Inputs) -> DataFrame:
    path = folder(t.spark)
    names = {"facility_id": "facilityId", "lat": "latitude", "lon": "longitude"}
    blank = [F.lit(None).cast("string").alias(c) for c in ("facilityName", "state", "primaryFuel")]
    rows = t.facility.select("*", *blank).withColumnsRenamed(names)
    rows.select("facilityId", "facilityName", "state", "latitude", "longitude", "primaryFuel", "tz").write.option("header", True).csv(path)
    wanted = t.events.where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("facility_id")).distinct()
    return readers.read_facilities(t.spark, path).join(wanted, "facility_id", "left_semi").select("facility_id", "lat", "lon", "tz")


@query(
    "a04_monitor_months",
    """WITH m AS (SELECT DISTINCT facility_id, date_trunc('month', x) AS m FROM (SELECT facility_id, unnest([t_start - INTERVAL 12 HOUR, t_start + INTERVAL 12 HOUR]) AS x FROM fx_overpass))
    SELECT c.facility_id, unit_id, epoch_us(t_hour) AS hour_us, count(*) AS n, round(sum(nox_mass),6) AS mass FROM fx_cems c
    JOIN m ON m.facility_id=c.facility_id AND m.m=date_trunc('month', t_hour) GROUP BY 1,2,3""",
    "fx_cems fx_overpass",
)
def a04(t: Inputs) -> DataFrame:
    path = folder(t.spark)
    sinks.write_parquet(t.cems.withColumns({"year": F.year("t_hour"), "month": F.month("t_hour")}), path, ["year", "month"])
    rows = readers.read_cems(t.spark, path, readers.needed_months(t.overpass, "t_start", 12.0))
    return rows.groupBy("facility_id", "unit_id", T.micros("t_hour").alias("hour_us")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("nox_mass"), 6).alias("mass"))


@query("a08_overpass_index", "SELECT overpass_id, facility_id, epoch_us(t_start) AS start_us, epoch_us(t_end) AS end_us FROM fx_overpass", "fx_overpass")
def a08(t: Inputs) -> DataFrame:
    path = folder(t.spark)
    late = F.pmod("overpass_id", F.lit(2)) == 1
    for part in (t.overpass.where(~late), t.overpass.where(late)):  # rows are appended
        sinks.write_overpass_index(part, path)
    return t.spark.read.parquet(path).select("overpass_id", "facility_id", T.micros("t_start").alias("start_us"), T.micros("t_end").alias("end_us"))


@query(
    "a09_clipped_files",
    "SELECT scene AS facility_id, scene AS granule_id, i, j, round(CAST(CAST(no2 AS FLOAT) AS DOUBLE),4) AS no2, round(CAST(CAST(qa AS FLOAT) AS DOUBLE),4) AS qa FROM fx_pixel",
    "fx_pixel",
)
def a09(t: Inputs) -> DataFrame:
    path = folder(t.spark)
    clipped = t.pixel.withColumns({"facility_id": F.col("scene"), "granule_id": F.col("scene")})
    sinks.write_clipped(clipped, path, ["no2", "qa", "not_there"])
    held = t.spark.read.parquet(path).select("facility_id", "granule_id", "i", "j", "no2", "qa")
    return held.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("no2", "qa")} | {"facility_id": F.col("facility_id").cast("bigint")})


@query("a10_matched_rows", "SELECT row_id, facility_id, flux, nobs, qf FROM fx_flux", "fx_flux")
def a10(t: Inputs) -> DataFrame:
    """Flux rows by facility, then the matched table, which replaces what an earlier run left."""
    rows, matched = folder(t.spark), folder(t.spark)
    kept = t.flux.select("row_id", "facility_id", "flux", "nobs", "qf")
    sinks.write_flux_rows(kept.withColumnRenamed("facility_id", "own").withColumn("facility_id", F.pmod("own", F.lit(16))), rows)  # folders of 16 groups
    back = t.spark.read.parquet(rows).drop("facility_id").withColumnRenamed("own", "facility_id")
    for _ in range(2):
        sinks.write_matched(back, matched)
    return t.spark.read.parquet(matched).select(*kept.columns)
