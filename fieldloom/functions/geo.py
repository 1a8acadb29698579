"""Distances and coordinate keys."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 equatorial radius in km and flattening; mean radius for the sphere.
RADIUS, FLATTENING, SPHERE = 6378.137, 1 / 298.257223563, 6371.0088


def sphere_km(lon1, lat1, lon2, lat2) -> Column:
    """Haversine distance."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * SPHERE * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def _ellipsoid(m, lon1, lat1, lon2, lat2):
    """Great circle with the Andoyer-Lambert flattening correction, as Meeus gives it; m has the functions."""
    f, g, k = m.rad((lat1 + lat2) / 2), m.rad((lat1 - lat2) / 2), m.rad((lon1 - lon2) / 2)
    sf, cf, sg, cg, sk, ck = m.sin(f), m.cos(f), m.sin(g), m.cos(g), m.sin(k), m.cos(k)
    s = sg * sg * ck * ck + cf * cf * sk * sk
    c = cg * cg * ck * ck + sf * sf * sk * sk
    w = m.atan(m.sqrt(s / c))
    r = m.sqrt(s * c) / w
    return 2 * w * RADIUS * (1 + FLATTENING * ((3 * r - 1) / (2 * c) * sf * sf * cg * cg - (3 * r + 1) / (2 * s) * cf * cf * sg * sg)), s


class _Columns:
    rad, sin, cos, atan, sqrt = F.radians, F.sin, F.cos, F.atan, F.sqrt


class _Arrays:
    rad, sin, cos, atan, sqrt = np.radians, np.sin, np.cos, np.arctan, np.sqrt


def ellipsoid_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    same = (lon1 == lon2) & (lat1 == lat2)
    return F.when(same, 0.0).otherwise(_ellipsoid(_Columns, lon1, lat1, lon2, lat2)[0])


def np_ellipsoid_km(lon1, lat1, lon2, lat2) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        d, s = _ellipsoid(_Arrays, np.asarray(lon1, float), np.asarray(lat1, float), np.asarray(lon2, float), np.asarray(lat2, float))
    return np.where(s == 0, 0.0, d)


def np_ellipsoid_matrix(lon1, lat1, lon2, lat2) -> np.ndarray:
    """All distances between two lists of points. Sines and cosines are taken of the points' half angles only and combined by products."""
    half = lambda v: np.radians(np.asarray(v, float)) / 2
    (sa, ca), (sb, cb) = ((np.sin(h), np.cos(h)) for h in (half(lat1)[:, None], half(lat2)[None, :]))
    (sx, cx), (sy, cy) = ((np.sin(h), np.cos(h)) for h in (half(lon1)[:, None], half(lon2)[None, :]))
    sf2, sg2, sk2 = (sa * cb + ca * sb) ** 2, (sa * cb - ca * sb) ** 2, (sx * cy - cx * sy) ** 2
    s = sg2 * (1 - sk2) + (1 - sf2) * sk2
    c = (1 - sg2) * (1 - sk2) + sf2 * sk2
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.arctan(np.sqrt(s / c))
        r = np.sqrt(s * c) / w
        d = 2 * w * RADIUS * (1 + FLATTENING * ((3 * r - 1) / (2 * c) * sf2 * (1 - sg2) - (3 * r + 1) / (2 * s) * (1 - sf2) * sg2))
    return np.where(s == 0, 0.0, d)


def ellipsoid_km_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """The same for an SQL engine, as a scalar subquery over named steps."""
    return f"""(SELECT CASE WHEN s = 0 THEN 0.0 ELSE 2 * w * {RADIUS!r} * (1 + {FLATTENING!r} * ((3 * r - 1) / (2 * c) * sf * sf * cg * cg - (3 * r + 1) / (2 * s) * cf * cf * sg * sg)) END
FROM (SELECT *, sqrt(s * c) / nullif(w, 0) AS r FROM (SELECT *, atan(sqrt(s / c)) AS w FROM (SELECT *, sg * sg * ck * ck + cf * cf * sk * sk AS s, cg * cg * ck * ck + sf * sf * sk * sk AS c
FROM (SELECT sin(f) AS sf, cos(f) AS cf, sin(g) AS sg, cos(g) AS cg, sin(k) AS sk, cos(k) AS ck FROM (SELECT radians(({lat1} + {lat2}) / 2) AS f, radians(({lat1} - {lat2}) / 2) AS g, radians(({lon1} - {lon2}) / 2) AS k))))))"""


def planar_d2(lon1, lat1, lon2, lat2) -> Column:
    return (lon1 - lon2) * (lon1 - lon2) + (lat1 - lat2) * (lat1 - lat2)


def coordinate_key(lon: Column, lat: Column, decimals: int = 8) -> Column:
    return F.format_string(f"%.{decimals}f_%.{decimals}f", lon, lat)


def point_in_degrees(km: float) -> float:
    """Degrees of latitude that hold so many km."""
    return km / (math.pi * SPHERE / 180)


def np_polygon_km(lon: np.ndarray, lat: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Distance from points to the union of polygons (rings of lon, lat); 0 inside. Edges are straight in a local projection around each point."""
    inside = np.zeros(len(lon), dtype=bool)
    best = np.full(len(lon), np.inf)
    for ring in rings:
        x1, y1 = ring[:, 0], ring[:, 1]
        x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
        crosses = (y1[None, :] > lat[:, None]) != (y2[None, :] > lat[:, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (x2 - x1)[None, :] * (lat[:, None] - y1[None, :]) / (y2 - y1)[None, :] + x1[None, :]
        inside ^= (crosses & (lon[:, None] < at)).sum(axis=1) % 2 == 1
        k = np.cos(np.radians(lat))[:, None]
        ax, ay = (x1[None, :] - lon[:, None]) * k, y1[None, :] - lat[:, None]
        bx, by = (x2[None, :] - lon[:, None]) * k, y2[None, :] - lat[:, None]
        dx, dy = bx - ax, by - ay
        t = np.clip(-(ax * dx + ay * dy) / np.maximum(dx * dx + dy * dy, 1e-300), 0, 1)
        px, py = ax + t * dx, ay + t * dy
        best = np.minimum(best, np.sqrt(px * px + py * py).min(axis=1))
    return np.where(inside, 0.0, np.radians(best) * SPHERE)
