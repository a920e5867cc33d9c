"""Positions: flat local frames, WGS84, bearings, points in polygons."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

#: The series of metres per degree of latitude and of longitude; WGS84 semi-major axis and squared eccentricity.
LAT_SERIES, LON_SERIES = (111132.92, -559.82, 1.175), (111412.84, -93.5)
WGS84_A, WGS84_E2 = 6378137.0, 6.69437999014e-3


def metres_per_degree(lat0: float) -> tuple[float, float]:
    """Of latitude and of longitude, at a latitude."""
    r = math.radians(lat0)
    return LAT_SERIES[0] + LAT_SERIES[1] * math.cos(2 * r) + LAT_SERIES[2] * math.cos(4 * r), LON_SERIES[0] * math.cos(r) + LON_SERIES[1] * math.cos(3 * r)


def to_local_flat(lat, lon, lat0: float, lon0: float) -> tuple[F.Column, F.Column]:
    """East and north of the origin, in metres."""
    north, east = metres_per_degree(lat0)
    return (lon - F.lit(lon0)) * east, (lat - F.lit(lat0)) * north


def to_geo_flat(x, y, lat0: float, lon0: float) -> tuple[F.Column, F.Column]:
    north, east = metres_per_degree(lat0)
    return y / north + lat0, x / east + lon0


def to_ecef(lat, lon, alt) -> tuple[F.Column, F.Column, F.Column]:
    s = F.sin(F.radians(lat))
    n = F.lit(WGS84_A) / F.sqrt(F.lit(1.0) - F.lit(WGS84_E2) * F.pow(s, F.lit(2.0)))
    c = F.cos(F.radians(lat))
    return (n + alt) * c * F.cos(F.radians(lon)), (n + alt) * c * F.sin(F.radians(lon)), (n * (1 - WGS84_E2) + alt) * s


def to_lla(x, y, z, steps: int = 6) -> tuple[F.Column, F.Column, F.Column]:
    """Latitude, longitude, height, by fixed-point steps."""
    p = F.sqrt(x * x + y * y)

    def radius(lat):
        return F.lit(WGS84_A) / F.sqrt(F.lit(1.0) - F.lit(WGS84_E2) * F.sin(lat) * F.sin(lat))

    def step(lat, _):
        return F.atan2(z, p * (F.lit(1.0) - F.lit(WGS84_E2) * radius(lat) * F.cos(lat) / p))

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.atan2(z, p * F.lit(1.0 - WGS84_E2)), step)
    return F.degrees(lat), F.degrees(F.atan2(y, x)), p / F.cos(lat) - radius(lat)


def ellipse(xx, xy, yy) -> tuple[F.Column, F.Column, F.Column]:
    """Standard deviations along the axes of a covariance, larger first, and the larger one's bearing, -180 to 180."""
    mean, half = (xx + yy) / 2, F.sqrt((xx - yy) * (xx - yy) / 4 + xy * xy)
    bearing = F.degrees(F.atan2(xy, mean + half - xx))
    return F.sqrt(F.greatest(mean + half, F.lit(0.0))), F.sqrt(F.greatest(mean - half, F.lit(0.0))), bearing


def wrapped(degrees) -> F.Column:
    """Between -180 and 180."""
    return F.pmod(degrees + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def pan_tilt(dx, dy, dz, yaw, pitch) -> tuple[F.Column, F.Column]:
    """Where a camera with this home direction turns to: degrees clockwise, degrees up."""
    level = F.sqrt(dx * dx + dy * dy)
    up = F.when(level > 1e-9, F.degrees(F.atan2(dz, level))).otherwise(F.signum(dz) * 90.0)
    return wrapped(F.degrees(F.atan2(dx, dy)) - yaw), F.least(F.greatest(up - pitch, F.lit(-90.0)), F.lit(90.0))


def spherical(x, y, z) -> tuple[F.Column, F.Column, F.Column]:
    """Azimuth and elevation in degrees, distance."""
    far = F.sqrt(x * x + y * y + z * z)
    return F.degrees(F.atan2(y, x)), F.when(far < 1e-9, 0.0).otherwise(F.degrees(F.asin(z / far))), far


def angle_difference(a, b) -> F.Column:
    """Between 0 and 180 degrees."""
    return F.abs(F.pmod(a - b + F.lit(180.0), F.lit(360.0)) - 180.0)


def in_polygon(lat, lon, polygon) -> F.Column:
    """Even-odd rule on an array of [lat, lon] vertices, without a join or a Python function."""
    n = F.size(polygon)

    def crosses(i):
        a, b = F.get(polygon, i), F.get(polygon, (i + 1) % n)
        lat_a, lon_a, lat_b, lon_b = F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(b, F.lit(0)), F.get(b, F.lit(1))
        spans = (lat_a > lat) != (lat_b > lat)
        return spans & (lon < (lon_b - lon_a) * (lat - lat_a) / (lat_b - lat_a + F.lit(1e-12)) + lon_a)

    hits = F.filter(F.sequence(F.lit(0), n - 1), crosses)
    return (n >= 3) & (F.size(hits) % 2 == 1)
