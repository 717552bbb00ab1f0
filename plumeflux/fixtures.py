"""Adapters that view the driver's tables as domain tables, in Spark and as SQL text."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeflux.functions.timeconv import day_index
from plumeflux.operators.series import with_series

GRID_LAT0, GRID_NLAT = 30.0, 16
GRID_LON0, GRID_NLON = -110.0, 41
SCENE_ROWS = 50


class Inputs:
    """Domain views over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def facility(self) -> DataFrame:
        uid = F.col("facility_id")
        zone = F.when(uid % 4 == 0, "America/New_York").when(uid % 4 == 1, "America/Chicago")
        return (
            self.events.select(F.col("user_id").alias("facility_id"))
            .distinct()
            .select(
                "facility_id",
                (30.0 + ((uid * 7) % 1500) / 100.0).alias("lat"),
                (-110.0 + ((uid * 13) % 4000) / 100.0).alias("lon"),
                zone.when(uid % 4 == 2, "America/Denver").otherwise("America/Phoenix").alias("tz"),
            )
        )

    @cached_property
    def cems(self) -> DataFrame:
        return self.events.select(
            F.col("user_id").alias("facility_id"),
            F.col("event_type").alias("unit_id"),
            F.date_trunc("hour", "ts").alias("t_hour"),
            F.when(F.col("event_type") != "error", F.col("value")).alias("nox_mass"),
        )

    @cached_property
    def overpass(self) -> DataFrame:
        return self.events.where("event_type = 'view'").select(
            F.col("event_id").alias("overpass_id"),
            F.col("user_id").alias("facility_id"),
            F.col("ts").alias("t_start"),
            (F.col("ts") + F.expr("INTERVAL '100' SECOND")).alias("t_end"),
        )

    @cached_property
    def trajectory(self) -> DataFrame:
        moves = self.events.select(
            F.col("user_id").alias("facility_id"),
            F.col("ts").alias("tstmp"),
            "event_id",
            ((F.col("event_id") * 37) % 100).alias("dlat"),
            ((F.col("event_id") * 53) % 100).alias("dlon"),
        )
        path = with_series(
            moves,
            ["facility_id"],
            ["tstmp", "event_id"],
            segment=day_index("tstmp"),
            row_number="rn",
            running={"sum_lat": "dlat", "sum_lon": "dlon"},
        )
        return path.select(
            "facility_id",
            (F.col("rn") - 1).alias("step_id"),
            "tstmp",
            (35.0 + 1e-4 * F.col("sum_lat")).alias("lat"),
            (-95.0 + 1e-4 * F.col("sum_lon")).alias("lon"),
        )

    @cached_property
    def pixel(self) -> DataFrame:
        cells = self.table("embeddings").select(
            F.floor(F.col("vec_id") / float(SCENE_ROWS)).cast("bigint").alias("scene"),
            (F.col("vec_id") % SCENE_ROWS).alias("i"),
            F.posexplode("embedding").alias("j", "v"),
        )
        return cells.select(
            "scene",
            "i",
            F.col("j").cast("bigint").alias("j"),
            (50.0 + 100.0 * F.col("v").cast("double")).alias("no2"),
            (2.0 + (F.col("i") + F.col("j")) % 3).alias("no2_sigma"),
            (((F.col("i") * 31 + F.col("j") * 17) % 100) / 100.0).alias("qa"),
            (35.0 + F.col("i") * 0.05).alias("lat"),
            (-95.0 + F.col("j") * 0.05).alias("lon"),
        )

    @cached_property
    def sample(self) -> DataFrame:
        g, x = F.col("transect_id"), F.col("dist_ortho")
        return self.events.select(
            F.col("user_id").alias("transect_id"),
            "event_id",
            (((F.col("event_id") * 37) % 401 - 200) * 0.5).alias("dist_ortho"),
            "value",
        ).select(
            "transect_id",
            "event_id",
            "dist_ortho",
            (
                20.0
                + 0.05 * x
                + 60.0 * F.exp(-4.0 * F.log(F.lit(2.0)) * F.pow(x - ((g % 21) - 10), 2) / F.pow(8 + g % 15, 2))
                + 0.01 * F.col("value")
            ).alias("no2"),
        )

    @cached_property
    def flux(self) -> DataFrame:
        eid = F.col("event_id")
        return self.events.where("event_type IN ('click', 'purchase')").select(
            eid.alias("row_id"),
            F.col("user_id").alias("facility_id"),
            F.col("ts").alias("t_overpass"),
            (((eid * 7) % 100) / 100.0).alias("age_hours"),
            F.col("value").alias("flux"),
            ((eid * 11) % 200).alias("nobs"),
            (((eid * 3) % 100) / 100.0).alias("rsq_detrend"),
            F.when(eid % 5 == 0, 1).otherwise(0).cast("bigint").alias("qf"),
            F.concat(
                F.lit("csf_S5P_OFFL_L2__NO2____"),
                F.date_format("ts", "yyyyMMdd'T'HHmmss"),
                F.lit("_20240131T000000_00001_03_020400_v1.csv"),
            ).alias("source_file"),
        )

    @cached_property
    def grid(self) -> DataFrame:
        return (
            self.events.select(F.date_trunc("day", "ts").alias("valid_time"))
            .distinct()
            .withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(GRID_NLAT - 1))))
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(GRID_NLON - 1))))
            .withColumns({"lat": F.col("a") + GRID_LAT0, "lon": F.col("o") + GRID_LON0})
            .select(
                "valid_time",
                "lat",
                "lon",
                (2.5e-8 + 1e-10 * F.col("lat") + 2e-10 * F.col("lon")).alias("o3"),
                (290.0 + 0.1 * F.col("lat")).alias("t_k"),
            )
        )

    @cached_property
    def scenes(self) -> DataFrame:
        """Which scene each facility lies in (facilities are dealt over the scenes)."""
        n = self.table("embeddings").agg((F.floor(F.max("vec_id") / float(SCENE_ROWS)) + 1).alias("n"))
        return self.facility.select("facility_id", F.pmod(F.col("facility_id"), n.scalar()).alias("scene"))


SQL_VIEWS = {
    "fx_facility": """SELECT DISTINCT user_id AS facility_id, 30e0 + ((user_id*7)%1500)/100e0 AS lat,
  -110e0 + ((user_id*13)%4000)/100e0 AS lon,
  CASE user_id%4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Chicago' WHEN 2 THEN 'America/Denver'
  ELSE 'America/Phoenix' END AS tz FROM events""",
    "fx_cems": """SELECT user_id AS facility_id, event_type AS unit_id, date_trunc('hour', ts) AS t_hour,
  CASE WHEN event_type='error' THEN NULL ELSE value END AS nox_mass FROM events""",
    "fx_overpass": """SELECT event_id AS overpass_id, user_id AS facility_id, ts AS t_start,
  ts + INTERVAL '100' SECOND AS t_end FROM events WHERE event_type='view'""",
    "fx_trajectory": """SELECT user_id AS facility_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step_id, ts AS tstmp,
  35e0 + 1e-4*CAST(SUM((event_id*37)%100) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS lat,
  -95e0 + 1e-4*CAST(SUM((event_id*53)%100) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS lon
  FROM events""",
    "fx_pixel": """SELECT scene, i, j, 50e0+100e0*v AS no2, CAST(2+(i+j)%3 AS DOUBLE) AS no2_sigma,
  ((i*31+j*17)%100)/100e0 AS qa, 35e0+i*0.05e0 AS lat, -95e0+j*0.05e0 AS lon FROM (
  SELECT CAST(floor(vec_id/50e0) AS BIGINT) AS scene, vec_id%50 AS i, unnest(range(len(embedding))) AS j,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) r""",
    "fx_sample": """SELECT g AS transect_id, event_id, x AS dist_ortho,
  20e0+0.05e0*x+60e0*exp(-4e0*ln(2e0)*power(x-((g%21)-10),2)/power(8+g%15,2))+0.01e0*value AS no2
  FROM (SELECT user_id AS g, event_id, ((event_id*37)%401-200)*0.5e0 AS x, value FROM events) q""",
    "fx_flux": """SELECT event_id AS row_id, user_id AS facility_id, ts AS t_overpass,
  ((event_id*7)%100)/100e0 AS age_hours, value AS flux, (event_id*11)%200 AS nobs,
  ((event_id*3)%100)/100e0 AS rsq_detrend, CASE WHEN event_id%5=0 THEN 1 ELSE 0 END AS qf,
  'csf_S5P_OFFL_L2__NO2____' || strftime(ts, '%Y%m%dT%H%M%S') || '_20240131T000000_00001_03_020400_v1.csv'
  AS source_file FROM events WHERE event_type IN ('click','purchase')""",
    "fx_grid": """SELECT h AS valid_time, 30e0+a AS lat, -110e0+o AS lon, 2.5e-8+1e-10*(30e0+a)+2e-10*(-110e0+o) AS o3,
  290e0+0.1e0*(30e0+a) AS t_k FROM (SELECT DISTINCT date_trunc('day', ts) AS h FROM events) d,
  range(16) x(a), range(41) y(o)""",
    "fx_scenes": """SELECT DISTINCT user_id AS facility_id,
  user_id % (SELECT CAST(floor(max(vec_id)/50e0) AS BIGINT)+1 FROM embeddings) AS scene FROM events""",
    "fx_hourly": """SELECT facility_id, t_hour, coalesce(sum(nox_mass),0)*0.000453592e0 AS tph
  FROM (SELECT user_id AS facility_id, date_trunc('hour', ts) AS t_hour,
  CASE WHEN event_type='error' THEN NULL ELSE value END AS nox_mass FROM events) c GROUP BY 1,2""",
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` (a SELECT, or further CTEs after ``WITH``) with the named views."""
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    text = body.strip()
    if not names:
        return text
    recursive = text.upper().startswith("WITH RECURSIVE")
    if text.upper().startswith("WITH"):
        rest = text[len("WITH RECURSIVE") if recursive else len("WITH") :]
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{rest.strip()}"
    return f"WITH {ctes}\n{text}"
