"""Time helpers: one microsecond clock, local hours and file-name stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumeflux.functions.geo import _col

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def micros(ts) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp"))


def from_micros(us) -> Column:
    return F.timestamp_micros(_col(us).cast("bigint"))


def hours_between(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / float(HOUR_US)


def minus_hours(ts, hours) -> Column:
    """``ts - hours`` for a fractional number of hours, to the microsecond."""
    return from_micros(micros(ts) - F.round(_col(hours) * float(HOUR_US), 0).cast("bigint"))


def midpoint(start, end) -> Column:
    begin = micros(start)
    return from_micros(begin + F.floor((micros(end) - begin) / 2))


def hour_index(ts) -> Column:
    """Whole hours since the epoch, the equi-join key for hourly data."""
    return F.floor(micros(ts) / F.lit(HOUR_US)).cast("bigint")


def day_index(ts) -> Column:
    return F.floor(micros(ts) / F.lit(DAY_US)).cast("bigint")


def local_to_utc(local, tz) -> Column:
    """Wall-clock time to UTC; hours skipped or repeated by a clock change become null."""
    local, tz = _col(local).cast("timestamp"), _col(tz)
    utc = F.to_utc_timestamp(local, tz)
    hour = F.expr("INTERVAL '1' HOUR")
    exists = F.from_utc_timestamp(utc, tz) == local
    repeated = (F.from_utc_timestamp(utc + hour, tz) == local) | (F.from_utc_timestamp(utc - hour, tz) == local)
    return F.when(exists & ~repeated, utc)


def overpass_time(file_name, version: str = "", token: int = 8) -> Column:
    """Scene start from a flux file name (``_`` token after prefix and version are cut)."""
    stem = F.regexp_replace(_col(file_name), r"\.csv$", "")
    if version:
        stem = F.regexp_replace(stem, "_" + version.replace(".", r"\.") + "$", "")
    stem = F.regexp_replace(stem, "^csf_", "")
    return F.try_to_timestamp(F.get(F.split(stem, "_"), F.lit(token)), F.lit("yyyyMMdd'T'HHmmss"))


def granule_time(file_name) -> Column:
    """First ``YYYYMMDDThhmmss`` group between dots; null when there is none."""
    stamp = F.regexp_extract(_col(file_name), r"\.(\d{8}T\d{6})\.", 1)
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd'T'HHmmss"))


def facility_slug(facility_id, name) -> Column:
    return F.replace(F.concat_ws("_", _col(facility_id), _col(name)), F.lit(" "), F.lit("_"))
