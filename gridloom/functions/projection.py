"""British National Grid to longitude and latitude and back, as column expressions.

A transverse Mercator series on the Airy 1830 ellipsoid and a seven-parameter shift of datum to
WGS84, by the published formulae of the national mapping agency; good to a few metres.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the grid, the two ellipsoids and the shift of datum from OSGB36 to WGS84.
SCALE, LAT0, LON0, EAST0, NORTH0 = 0.9996012717, math.radians(49), math.radians(-2), 400000.0, -100000.0
AIRY = (6377563.396, 6356256.909)
WGS84 = (6378137.0, 6356752.314245)
SHIFT = (446.448, -125.157, 542.060)
TURN = (0.1502, 0.2470, 0.8421)
PARTS_PER_MILLION = -20.4894


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _settled(start: Column, step: Callable[[Column], Column], rounds: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda value, _: step(value))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _p(c: Column, power: float) -> Column:
    return F.pow(c, F.lit(float(power)))


def _arc(lat: Column) -> Column:
    """Length of the meridian from the true origin."""
    a, b = AIRY
    n = (a - b) / (a + b)
    d, s = lat - LAT0, lat + LAT0
    return b * SCALE * (
        (1 + n + 5 / 4 * n**2 + 5 / 4 * n**3) * d - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(d) * F.cos(s) + (15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * d) * F.cos(2 * s) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * s)
    )


def _radii(lat: Column) -> Column:
    """Struct of the radii of curvature across (nu) and along (rho) the meridian, and tan of the latitude."""
    a, b = AIRY
    e2 = 1 - (b / a) ** 2
    w = 1 - e2 * _p(F.sin(lat), 2)
    return F.struct((a * SCALE / F.sqrt(w)).alias("nu"), (a * SCALE * (1 - e2) / _p(w, 1.5)).alias("rho"), F.tan(lat).alias("t"))


def grid_to_airy(x: Column, y: Column, rounds: int = 5) -> Column:
    """Struct (x: longitude, y: latitude) in radians on the grid's own datum."""
    step = AIRY[0] * SCALE

    def series(lat: Column, d: Column, nu: Column, rho: Column, t: Column) -> Column:
        eta, sec = nu / rho - 1, 1 / F.cos(lat)
        north = lat - t / (2 * rho * nu) * _p(d, 2) + t / (24 * rho * _p(nu, 3)) * (5 + 3 * _p(t, 2) + eta - 9 * _p(t, 2) * eta) * _p(d, 4) - t / (720 * rho * _p(nu, 5)) * (61 + 90 * _p(t, 2) + 45 * _p(t, 4)) * _p(d, 6)
        east = LON0 + sec / nu * d - sec / (6 * _p(nu, 3)) * (nu / rho + 2 * _p(t, 2)) * _p(d, 3) + sec / (120 * _p(nu, 5)) * (5 + 28 * _p(t, 2) + 24 * _p(t, 4)) * _p(d, 5) - sec / (5040 * _p(nu, 7)) * (61 + 662 * _p(t, 2) + 1320 * _p(t, 4) + 720 * _p(t, 6)) * _p(d, 7)
        return _point(east, north)

    def of(g: Column) -> Column:
        lat = _settled((g["y"] - NORTH0) / step + LAT0, lambda v: v + (g["y"] - NORTH0 - _arc(v)) / step, rounds)
        return _let(lat, lambda v: _let(_radii(v), lambda r: series(v, g["x"] - EAST0, r["nu"], r["rho"], r["t"])))

    return _let(_point(x.cast("double"), y.cast("double")), of)


def airy_to_grid(place: Column) -> Column:
    """Struct (x: easting, y: northing) of longitude and latitude in radians on the grid's own datum."""

    def series(g: Column, nu: Column, rho: Column, t: Column) -> Column:
        s, c, d, eta = F.sin(g["y"]), F.cos(g["y"]), g["x"] - LON0, nu / rho - 1
        north = _arc(g["y"]) + NORTH0 + nu / 2 * s * c * _p(d, 2) + nu / 24 * s * _p(c, 3) * (5 - _p(t, 2) + 9 * eta) * _p(d, 4) + nu / 720 * s * _p(c, 5) * (61 - 58 * _p(t, 2) + _p(t, 4)) * _p(d, 6)
        east = EAST0 + nu * c * d + nu / 6 * _p(c, 3) * (nu / rho - _p(t, 2)) * _p(d, 3) + nu / 120 * _p(c, 5) * (5 - 18 * _p(t, 2) + _p(t, 4) + 14 * eta - 58 * _p(t, 2) * eta) * _p(d, 5)
        return _point(east, north)

    return _let(place, lambda g: _let(_radii(g["y"]), lambda r: series(g, r["nu"], r["rho"], r["t"])))


def _shifted(place: Column, source: tuple[float, float], target: tuple[float, float], sign: int, rounds: int = 4) -> Column:
    """Longitude and latitude moved between datums by way of earth-centred coordinates."""
    rx, ry, rz = (sign * math.radians(t / 3600) for t in TURN)
    k = 1 + sign * PARTS_PER_MILLION / 1e6
    tx, ty, tz = (sign * t for t in SHIFT)

    def across(axes: tuple[float, float], lat: Column) -> tuple[Column, float]:
        e2 = 1 - (axes[1] / axes[0]) ** 2
        return axes[0] / F.sqrt(1 - e2 * _p(F.sin(lat), 2)), e2

    def centred(g: Column) -> Column:
        nu, e2 = across(source, g["y"])
        return F.struct((nu * F.cos(g["y"]) * F.cos(g["x"])).alias("x"), (nu * F.cos(g["y"]) * F.sin(g["x"])).alias("y"), (nu * (1 - e2) * F.sin(g["y"])).alias("z"))

    def turned(q: Column) -> Column:
        x, y, z = q["x"], q["y"], q["z"]
        return F.struct((tx + k * x - rz * y + ry * z).alias("x"), (ty + rz * x + k * y - rx * z).alias("y"), (tz - ry * x + rx * y + k * z).alias("z"))

    def back(q: Column) -> Column:
        flat = F.hypot(q["x"], q["y"])
        start = F.atan2(q["z"], flat * (target[1] / target[0]) ** 2)

        def nearer(lat: Column) -> Column:
            nu, e2 = across(target, lat)
            return F.atan2(q["z"] + e2 * nu * F.sin(lat), flat)

        return _point(F.atan2(q["y"], q["x"]), _settled(start, nearer, rounds))

    return _let(place, lambda g: _let(centred(g), lambda q: _let(turned(q), back)))


def to_lonlat(x: Column, y: Column) -> Column:
    """Struct (x, y) of WGS84 longitude and latitude in degrees of a grid coordinate."""
    return _let(_shifted(grid_to_airy(x, y), AIRY, WGS84, 1), lambda g: _point(F.degrees(g["x"]), F.degrees(g["y"])))


def to_grid(lon: Column, lat: Column) -> Column:
    """Struct (x, y) of the grid coordinate of a WGS84 longitude and latitude in degrees."""
    return airy_to_grid(_shifted(_point(F.radians(lon), F.radians(lat)), WGS84, AIRY, -1))
