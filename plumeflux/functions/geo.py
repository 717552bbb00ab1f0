"""Spherical geometry as column expressions (degrees in, metres or degrees out)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from plumeflux.config import EARTH_RADIUS_M


def _col(c: Column | str | float) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(float(c))


def haversine_m(lat1, lon1, lat2, lon2, radius_m: float = EARTH_RADIUS_M) -> Column:
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = F.sin(half_dlat) * F.sin(half_dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(
        half_dlon
    ) * F.sin(half_dlon)
    return F.lit(2.0 * radius_m) * F.asin(F.sqrt(chord))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from point 1 to point 2, in [0, 360)."""
    lat1, lon1, lat2, lon2 = (F.radians(_col(c)) for c in (lat1, lon1, lat2, lon2))
    east = F.sin(lon2 - lon1) * F.cos(lat2)
    north = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def wrap180(delta) -> Column:
    """Signed angle in [-180, 180)."""
    return F.pmod(_col(delta) + 180.0, F.lit(360.0)) - 180.0


def wrap_lon(lon) -> Column:
    """Longitude folded into [-180, 180)."""
    return wrap180(lon)


def destination(lat, lon, bearing, dist_km, radius_m: float = EARTH_RADIUS_M) -> tuple[Column, Column]:
    """Great-circle end point (lat, lon) after ``dist_km`` along ``bearing``."""
    lat, lon, bearing, dist_km = map(_col, (lat, lon, bearing, dist_km))
    phi, theta, delta = F.radians(lat), F.radians(bearing), dist_km / (radius_m / 1e3)
    sin_end = F.sin(phi) * F.cos(delta) + F.cos(phi) * F.sin(delta) * F.cos(theta)
    lat_end = F.degrees(F.asin(sin_end))
    lon_end = lon + F.degrees(
        F.atan2(F.sin(theta) * F.sin(delta) * F.cos(phi), F.cos(delta) - F.sin(phi) * F.sin(F.radians(lat_end)))
    )
    return lat_end, lon_end


def destination_arrays(lat, lon, bearing, dist_km, radius_m: float = EARTH_RADIUS_M) -> tuple[np.ndarray, np.ndarray]:
    """``destination`` of numpy arrays."""
    phi, theta, delta = np.radians(lat), np.radians(bearing), dist_km / (radius_m / 1e3)
    sin_phi, cos_phi, sin_delta, cos_delta = np.sin(phi), np.cos(phi), np.sin(delta), np.cos(delta)
    lat_end = np.degrees(np.arcsin(sin_phi * cos_delta + cos_phi * sin_delta * np.cos(theta)))
    lon_end = lon + np.degrees(np.arctan2(np.sin(theta) * sin_delta * cos_phi, cos_delta - sin_phi * np.sin(np.radians(lat_end))))
    return lat_end, lon_end


def planar_dist2(lat1, lon1, lat2, lon2) -> Column:
    """Squared distance in plain degrees, the measure used for pixel proximity."""
    dlon, dlat = _col(lon1) - _col(lon2), _col(lat1) - _col(lat2)
    return dlon * dlon + dlat * dlat


def in_box(lat, lon, lat_min, lat_max, lon_min, lon_max) -> Column:
    """Strict box test; bounds beyond +-180 are wrapped, so boxes may cross the dateline."""
    lat, lon = _col(lat), _col(lon)
    west, east = wrap_lon(lon_min), wrap_lon(lon_max)
    inside_lon = F.when(west <= east, (lon > west) & (lon < east)).otherwise((lon > west) | (lon < east))
    return (lat > _col(lat_min)) & (lat < _col(lat_max)) & inside_lon
