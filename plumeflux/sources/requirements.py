"""Which meteorology days the trajectory runs of a set of overpasses need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeflux.functions.timeconv import hours_between


def run_windows(overpass: DataFrame, time: str, before_h: int = 2, after_h: int = 6) -> DataFrame:
    """Start, end and whole-hour duration of the run for each overpass."""
    start, end = F.col(time) - F.make_interval(hours=F.lit(before_h)), F.col(time) + F.make_interval(hours=F.lit(after_h))
    return overpass.withColumns({"run_start": start, "run_end": end}).withColumn(
        "run_hours", F.ceil(hours_between("run_end", "run_start")).cast("int")
    )


def required_days(overpass: DataFrame, time: str, before_h: int = 2, after_h: int = 6, mode: str = "plume") -> DataFrame:
    """One row per overpass and day its run reads, through one hour after the run's end.

    ``day_order`` is the order in which the run reads them: ascending, descending for ``bg``.
    """
    runs = run_windows(overpass, time, before_h, after_h)
    days = F.sequence(F.to_date("run_start"), F.to_date(F.col("run_end") + F.make_interval(hours=F.lit(1))))
    ordered = F.reverse(days) if mode == "bg" else days
    return runs.select("*", F.posexplode(ordered).alias("day_order", "day"))


def missing_days(required: DataFrame, available: DataFrame) -> DataFrame:
    return required.select("day").distinct().join(available.select("day"), "day", "left_anti")
