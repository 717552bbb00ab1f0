"""Readers that turn files into domain tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeflux.functions.timeconv import local_to_utc, minus_hours, overpass_time
from plumeflux.operators.scale import broadcast_checked

FACILITY_SCHEMA = "facilityId string, facilityName string, state string, latitude double, longitude double, primaryFuel string, tz string"
# The fields of a trajectory text row, in file order.
TRAJECTORY_FIELDS = (
    "traj_no", "grid_no", "year", "month", "day", "hour", "minute", "forecast_hour", "age_hours", "lat", "lon", "z_magl", "pres", "temp",
)
# Columns of a flux file that the comparison does not use.
FLUX_DROPPED = ("lon_a3_i", "lon_a3_f", "lat_a3_i", "lat_a3_f")


def read_facilities(spark: SparkSession, path: str, ids: Sequence[str] | None = None, schema: str = FACILITY_SCHEMA) -> DataFrame:
    """Facility CSV with string ids; optionally only the listed ids."""
    raw = spark.read.csv(path, header=True, schema=schema)
    out = raw.withColumnsRenamed(
        {"facilityId": "facility_id", "facilityName": "facility_name", "latitude": "lat", "longitude": "lon", "primaryFuel": "primary_fuel"}
    )
    if ids is None:
        return out
    listed = spark.createDataFrame([(str(i),) for i in ids], "facility_id string")
    return out.join(listed, "facility_id", "left_semi")


def explode_swath(granules: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("granule_id",)) -> DataFrame:
    """Array rows (scanline x pixel per variable, one time per scanline) to one row per pixel.

    ``i`` and ``j`` are raster indices; ``t_utc`` is the time of the pixel's scanline.
    """
    lines = granules.select(*keys, F.posexplode(F.arrays_zip("scan_time", *variables)).alias("i", "__line"))
    cells = lines.select(
        *keys, "i", F.col("__line.scan_time").alias("t_utc"), F.posexplode(F.arrays_zip(*[F.col(f"__line.{v}").alias(v) for v in variables])).alias("j", "__px")
    )
    return cells.select(*keys, "i", "j", "t_utc", *[F.col(f"__px.{v}").alias(v) for v in variables])


def pixel_ring(lat_bounds: str = "lat_bounds", lon_bounds: str = "lon_bounds"):
    """Closed five-point rings (lat, lon); null when any corner is missing."""
    def finite(c: str):
        return F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))

    def ring(c: str):
        return F.when(finite(lat_bounds) & finite(lon_bounds), F.concat(F.col(c), F.slice(c, 1, 1)))

    return ring(lat_bounds), ring(lon_bounds)


def parse_trajectories(files: DataFrame) -> DataFrame:
    """Rows of whole trajectory files (columns ``path``, ``value``) to trajectory points.

    The first token of a file counts its met files; that many plus four lines are skipped.
    Two-digit years mean 20yy and ``step_id`` is the line order.
    """
    lines = F.split("value", r"\r?\n")
    n_met = F.regexp_extract("value", r"^\s*(\d+)", 1).cast("int")
    body = F.filter(F.slice(lines, n_met + 5, F.size(lines)), lambda v: F.trim(v) != "")
    rows = files.select("path", F.posexplode(body).alias("step_id", "__line"))
    tokens = rows.select("path", "step_id", F.split(F.trim("__line"), r"\s+").alias("__t"))
    field = {name: F.get("__t", F.lit(n)) for n, name in enumerate(TRAJECTORY_FIELDS)}

    def number(c: str):
        return field[c].cast("double")

    stamp = F.make_timestamp(
        number("year").cast("int") + 2000, *[number(c).cast("int") for c in ("month", "day", "hour", "minute")], F.lit(0).cast("decimal(16,6)")
    )
    return tokens.select(
        "path", F.col("step_id").cast("bigint"), stamp.alias("tstmp"), *[number(c).alias(c) for c in TRAJECTORY_FIELDS[7:]]
    )


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Trajectory files named ``tdump_<sat>_<facility>_<mode>_<yyyymmddHHMM>_<version>``."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    name = F.split(F.element_at(F.split("path", "/"), -1), "_")
    return parse_trajectories(files).select(
        F.get(name, F.lit(2)).alias("facility_id"), F.get(name, F.lit(4)).alias("overpass_id"), "*"
    ).drop("path")


def read_cems(spark: SparkSession, path: str, months: DataFrame | None = None) -> DataFrame:
    """Monitor rows partitioned by facility_id, year, month; only the partitions listed in ``months``."""
    raw = spark.read.option("basePath", path).parquet(path)
    if months is None:
        return raw
    listed, _ = broadcast_checked(months.distinct())
    return raw.join(listed, ["facility_id", "year", "month"], "left_semi")


def _by_header(lines: DataFrame, is_header: Column) -> tuple[DataFrame | None, DataFrame]:
    """Rows of CSV ``lines`` (value, file and others) by the columns of their own file's header, united by name as text.

    Every header version is parsed once, however many files share it; a file may have its columns in any order.
    Also (file, header) of the files that have one; no rows (None) when no file has.
    """
    heads = lines.where(is_header).groupBy("file").agg(F.min("value").alias("header"))
    parts = []
    for version in heads.select("header").distinct().orderBy("header").collect():
        cols = [c.strip().strip('"') for c in version["header"].split(",")]
        mine = lines.where(~is_header).join(heads.where(F.col("header") == version["header"]), "file").where("value <> ''")
        rows = mine.select(*[c for c in lines.columns if c != "value"], F.from_csv("value", F.lit(", ".join(f"`{c}` string" for c in cols))).alias("__r"))
        parts.append(rows.select(*[c for c in rows.columns if c != "__r"], *[F.col(f"__r.`{c}`") for c in cols if c not in FLUX_DROPPED]))
    return (reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts) if parts else None), heads


def read_cems_csv(spark: SparkSession, path: str, months: DataFrame | None = None) -> DataFrame:
    """Monthly monitor files ``<facility>_<name>_<yyyy>_<mm>.csv`` below ``path`` as rows of text columns.

    Adds facility_id, facility_name, year, month and file from the file's name. With ``months``
    (facility_id, year, month) files of other calendar months are not listed for the scan, and rows of
    other facilities' months are dropped. Files without a header of ``date``, ``hour`` and ``noxMass`` give no rows.
    """
    pattern = "*.csv"
    if months is not None:
        calendar = sorted(f"{r['year']}_{r['month']:02d}" for r in months.select("year", "month").distinct().collect())  # twelve a year
        pattern = "*_{" + ",".join(calendar or ["none"]) + "}.csv"
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    lines = raw.select("value", F.col("_metadata.file_path").alias("file"), F.url_decode("_metadata.file_name").alias("__name"))
    rows, _ = _by_header(lines, _monitor_header())
    if rows is None:
        return spark.createDataFrame([], "file string, date string, hour string, noxMass string, facility_id string, facility_name string, year int, month int")
    parts = [F.regexp_extract("__name", r"^([^_]+)_(.*)_(\d{4})_(\d{2})\.csv$", n) for n in range(1, 5)]
    named = rows.select(*[c for c in rows.columns if c != "__name"], parts[0].alias("facility_id"), parts[1].alias("facility_name"), *[p.try_cast("int").alias(c) for p, c in zip(parts[2:], ("year", "month"))])
    if months is None:
        return named
    return named.join(months.select("facility_id", "year", "month").distinct(), ["facility_id", "year", "month"], "left_semi")


def _monitor_header() -> Column:
    return reduce(lambda a, b: a & b, [F.col("value").rlike(rf'(^|,)\s*"?{c}"?\s*(,|$)') for c in ("date", "hour", "noxMass")])


def needed_months(rows: DataFrame, time: str, tol_hours: float) -> DataFrame:
    """(facility_id, year, month) of every month that matching ``time`` within the tolerance can read."""
    early, late = minus_hours(time, F.lit(tol_hours)), minus_hours(time, F.lit(-tol_hours))
    months = F.explode(F.array_distinct(F.array(F.date_trunc("month", early), F.date_trunc("month", late))))
    out = rows.where(F.col(time).isNotNull()).select("facility_id", months.alias("m"))
    return out.select("facility_id", F.year("m").alias("year"), F.month("m").alias("month")).distinct()


def with_utc_hour(cems: DataFrame, facilities: DataFrame, date: str = "date", hour: str = "hour") -> DataFrame:
    """Monitor rows with ``tstmp_utc`` from local date, hour and the facility's zone (default UTC)."""
    zoned = cems.join(facilities.select("facility_id", F.coalesce("tz", F.lit("UTC")).alias("__tz")), "facility_id")
    local = F.col(date).cast("timestamp") + F.make_interval(hours=F.col(hour).cast("int"))
    return zoned.withColumn("tstmp_utc", local_to_utc(local, "__tz")).drop("__tz")


# Columns of flux files that hold text.
FLUX_TEXT = ("traj", "fit_status", "status", "option")


def _flux_lines(spark: SparkSession, path: str, step: str) -> tuple[DataFrame, Column]:
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "csf_*.csv")
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("source_file"))
        .where(~F.col("source_file").contains("_cems"))
    )
    return lines, F.col("value").rlike(rf"(^|,){re.escape(step)}(,|$)")


def flux_file_report(spark: SparkSession, path: str, step: str = "step_id") -> DataFrame:
    """Per flux file with any line: source_file, file, its number of data rows and status (``ok`` or ``no_header``)."""
    lines, is_header = _flux_lines(spark, path, step)
    some = F.max(F.when(is_header, 1).otherwise(0)) == 1
    rows = F.sum(F.when(~is_header & (F.col("value") != ""), 1).otherwise(0))
    return lines.groupBy("source_file", "file").agg(rows.alias("n_rows"), F.when(some, "ok").otherwise("no_header").alias("status"))


def read_flux_rows(
    spark: SparkSession, path: str, version: str = "", age: str = "age_hours", overpass_token: int = 8, step: str = "step_id", text_columns: Sequence[str] = FLUX_TEXT, on_bad: str = "fail"
) -> DataFrame:
    """All ``csf_*.csv`` under ``<facility>_<name>/`` folders as one table, columns matched by name.

    Files may have different columns: every header version is parsed with its own columns and the
    parts are united by name. ``_cems`` files are skipped. Adds source_file, facility_id,
    facility_name, t_overpass and t_emission. ``step`` names the step column that marks a header, read as
    step_id; ``text_columns`` stay text, the others become numbers. A file without such a header is an
    error, or with ``on_bad='skip'`` left out (``flux_file_report`` names it); no readable file at all is an error.
    """
    lines, is_header = _flux_lines(spark, path, step)
    out, heads = _by_header(lines, is_header)
    if out is None:
        raise ValueError(f"no flux files with a {step} column under {path}")
    unread = lines.select("file").distinct().join(heads, "file", "left_anti").limit(3).collect() if on_bad == "fail" else []
    if unread:
        raise ValueError(f"flux files without a {step} column: {[r['file'] for r in unread]}")
    numeric = [c for c in out.columns if c not in ("file", "source_file", "facility_id", "facility_name", "time_tag", *text_columns)]
    out = out.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in numeric})
    if step != "step_id":
        out = out.withColumnRenamed(step, "step_id")
    if "time_tag" in out.columns:
        out = out.withColumn("time_tag", F.try_to_timestamp("time_tag"))
    folder = F.url_decode(F.element_at(F.split("file", "/"), -2))
    out = out.withColumns(
        {
            "facility_id": F.regexp_extract(folder, r"^([^_]+)_", 1),
            "facility_name": F.regexp_extract(folder, r"^[^_]+_(.*)$", 1),
            "t_overpass": overpass_time("source_file", version, overpass_token),
        }
    ).drop("file")
    hours = F.col(age) if age in out.columns else F.lit(None).cast("double")
    return out.withColumn("age_hours", hours).withColumn("t_emission", minus_hours("t_overpass", "age_hours"))
