"""Coordinate systems by formula: geographic, web Mercator, and transverse Mercator zones.

Transverse Mercator is the Krueger series in the third flattening (Karney 2011, to n^4).
Longitude is always x and latitude y. Datums of the supported systems coincide within the
accuracy claimed here (WGS 84, CGCS2000), so no shift is made between them.
"""

from __future__ import annotations

import math
import re

import numpy as np

from geoframe.types import SpatialRef

ELLIPSOIDS = {"wgs84": (6378137.0, 1 / 298.257223563), "cgcs2000": (6378137.0, 1 / 298.257222101)}


class CoordTransformError(ValueError):
    """A coordinate system that isn't known, or coordinates out of its reach."""


def resolve(crs) -> int:
    """An EPSG code of a number, text ("EPSG:3857", "ESRI:n" is read as EPSG) or SpatialRef."""
    if isinstance(crs, bool):
        raise CoordTransformError("a truth value isn't a coordinate system")
    if isinstance(crs, SpatialRef):
        crs = crs.effective_wkid
    if isinstance(crs, str):
        found = re.fullmatch(r"\s*(?:EPSG|ESRI)?:?(\d+)\s*", crs, re.I) or re.search(r'(?:AUTHORITY|ID)\["EPSG",\s*"?(\d+)"?\]\]?\s*$', crs)
        if not found:
            raise CoordTransformError(f"unknown coordinate system {crs[:60]!r}")
        crs = int(found.group(1))
    _params(crs)
    return crs


def _params(code: int) -> tuple:
    """(kind, ellipsoid, central meridian, scale, false easting, false northing)."""
    if code in (4326, 4979, 4258, 4490):
        return ("geographic", "cgcs2000" if code == 4490 else "wgs84", 0, 1, 0, 0)
    if code in (3857, 102100, 900913):
        return ("mercator", "wgs84", 0, 1, 0, 0)
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return ("tm", "wgs84", (code % 100) * 6 - 183, 0.9996, 500000.0, 0.0 if code < 32700 else 10000000.0)
    if 4491 <= code <= 4501:  # 6 degree zones 13 to 23, with the zone before the easting
        return ("tm", "cgcs2000", (code - 4478) * 6 - 3, 1, (code - 4478) * 1e6 + 500000, 0.0)
    if 4502 <= code <= 4512:  # the same by central meridian
        return ("tm", "cgcs2000", (code - 4489) * 6 - 3, 1, 500000.0, 0.0)
    if 4513 <= code <= 4533:  # 3 degree zones 25 to 45
        return ("tm", "cgcs2000", (code - 4488) * 3, 1, (code - 4488) * 1e6 + 500000, 0.0)
    if 4534 <= code <= 4554:
        return ("tm", "cgcs2000", (code - 4509) * 3, 1, 500000.0, 0.0)
    raise CoordTransformError(f"EPSG:{code} isn't supported")


def _series(f: float):
    n = f / (2 - f)
    a = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return a, forward, back


def _to_geographic(code: int, x, y):
    kind, ell, lon0, k, fe, fn = _params(code)
    a, f = ELLIPSOIDS[ell]
    if kind == "geographic":
        return x, y
    if kind == "mercator":
        return np.degrees(x / a), np.degrees(2 * np.arctan(np.exp(y / a)) - math.pi / 2)
    scale, _, back = _series(f)
    xi, eta = (y - fn) / (k * a * scale), (x - fe) / (k * a * scale)
    x1 = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(back, 1))
    e1 = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(back, 1))
    t = np.sin(x1) / np.sqrt(np.sinh(e1) ** 2 + np.cos(x1) ** 2)  # tangent of the conformal latitude
    e = math.sqrt(f * (2 - f))
    tau = t
    for _ in range(6):  # Newton's steps to the tangent of the latitude
        s = np.sinh(e * np.arctanh(e * tau / np.sqrt(1 + tau**2)))
        at = tau * np.sqrt(1 + s**2) - s * np.sqrt(1 + tau**2)
        tau = tau + (t - at) / np.sqrt(1 + at**2) * (1 + (1 - e * e) * tau**2) / ((1 - e * e) * np.sqrt(1 + tau**2))
    return lon0 + np.degrees(np.arctan2(np.sinh(e1), np.cos(x1))), np.degrees(np.arctan(tau))


def _from_geographic(code: int, lon, lat):
    kind, ell, lon0, k, fe, fn = _params(code)
    a, f = ELLIPSOIDS[ell]
    if kind == "geographic":
        return lon, lat
    if kind == "mercator":
        return a * np.radians(lon), a * np.log(np.tan(math.pi / 4 + np.radians(lat) / 2))
    scale, forward, _ = _series(f)
    e = math.sqrt(f * (2 - f))
    tau, d = np.tan(np.radians(lat)), np.radians(lon - lon0)
    s = np.sinh(e * np.arctanh(e * tau / np.sqrt(1 + tau**2)))
    t = tau * np.sqrt(1 + s**2) - s * np.sqrt(1 + tau**2)
    xi, eta = np.arctan2(t, np.cos(d)), np.arcsinh(np.sin(d) / np.sqrt(t**2 + np.cos(d) ** 2))
    x1 = xi + sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(forward, 1))
    e1 = eta + sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(forward, 1))
    return fe + k * a * scale * e1, fn + k * a * scale * x1


def transform(x, y, src, dst):
    """Arrays of x and y from one system to another."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    return _from_geographic(resolve(dst), *_to_geographic(resolve(src), x, y))


def quantization(xmin: float, ymin: float, xmax: float, ymax: float, geographic: bool) -> dict:
    if geographic:
        return {"xorigin": -180.0, "yorigin": -90.0, "xyscale": 1e6, "xytolerance": 2e-6}
    low = lambda a, b: math.floor(a - max(1.0, (b - a) / 2))
    return {"xorigin": float(low(xmin, xmax)), "yorigin": float(low(ymin, ymax)), "xyscale": 20000.0, "xytolerance": 1e-4}
