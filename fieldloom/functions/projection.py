"""Coordinates of projected rasters as longitude and latitude: Mercator on the sphere and Albers' equal-area cone on an
ellipsoid, by Snyder's published formulas (Map projections: a working manual, 1987), as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.geo import FLATTENING, RADIUS

#: Registered numbers of longitude and latitude, and of Mercator on a sphere of the equatorial radius.
LONLAT, MERCATOR = 4326, 3857


@dataclass(frozen=True)
class Albers:
    """Two standard parallels and the origin, in degrees; metres."""

    first: float
    second: float
    lon: float
    lat: float = 0.0
    east: float = 0.0
    north: float = 0.0
    radius: float = RADIUS * 1000
    flattening: float = FLATTENING

    @property
    def e(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    def _q(self, sine: float) -> float:
        e = self.e
        return (1 - e * e) * (sine / (1 - (e * sine) ** 2) - math.log((1 - e * sine) / (1 + e * sine)) / (2 * e))

    def constants(self) -> tuple[float, float, float]:
        """n, C and rho of the origin."""
        m2 = lambda s: (1 - s * s) / (1 - (self.e * s) ** 2)
        a, b = (math.sin(math.radians(p)) for p in (self.first, self.second))
        n = (m2(a) - m2(b)) / (self._q(b) - self._q(a)) if a != b else a
        c = m2(a) + n * self._q(a)
        return n, c, self.radius * math.sqrt(c - n * self._q(math.sin(math.radians(self.lat)))) / n


def to_lonlat(x: Column, y: Column, system: int | Albers) -> tuple[Column, Column]:
    """Longitude and latitude of projected coordinates."""
    if system == LONLAT:
        return x, y
    if system == MERCATOR:
        r = RADIUS * 1000
        return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - math.pi / 2)
    if not isinstance(system, Albers):
        raise ValueError(f"reference system {system} is not known; give its parameters as Albers")
    p, (n, c, origin) = system, system.constants()
    e, dx, dy = p.e, x - p.east, origin - (y - p.north)
    rho, sign = F.sqrt(dx * dx + dy * dy), math.copysign(1.0, n)
    q = (c - F.pow(rho * n / p.radius, F.lit(2.0))) / n

    def better(phi: Column) -> Column:  # one step of Newton's method on q
        s = F.sin(phi)
        t = 1 - (e * e) * s * s
        return phi + t * t / (2 * F.cos(phi)) * (q / (1 - e * e) - s / t + F.log((1 - e * s) / (1 + e * s)) / (2 * e))

    start = F.asin(F.greatest(F.least(q / 2, F.lit(1.0)), F.lit(-1.0)))
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, lambda a, _: better(a))
    return F.degrees(F.atan2(sign * dx, sign * dy) / n) + p.lon, F.degrees(phi)


def from_lonlat(lon: Column, lat: Column, system: int | Albers) -> tuple[Column, Column]:
    """Projected coordinates of longitude and latitude."""
    if system == LONLAT:
        return lon, lat
    if system == MERCATOR:
        r = RADIUS * 1000
        return r * F.radians(lon), r * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))
    if not isinstance(system, Albers):
        raise ValueError(f"reference system {system} is not known; give its parameters as Albers")
    p, (n, c, origin) = system, system.constants()
    e, s = p.e, F.sin(F.radians(lat))
    q = (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = p.radius * F.sqrt(c - n * q) / n, n * F.radians(lon - p.lon)
    return p.east + rho * F.sin(theta), p.north + origin - rho * F.cos(theta)
