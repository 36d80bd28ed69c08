"""Column functions on rings: closed arrays of struct<x double, y double>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(ring: Column) -> Column:
    """Array of (p, q): every point with the next one."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _sum(edges: Column, f) -> Column:  # noqa: ANN001
    return F.aggregate(edges, F.lit(0.0), lambda total, e: total + f(e["p"], e["q"]))


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive for counter-clockwise rings."""
    return _sum(_edges(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_length(ring: Column) -> Column:
    return _sum(_edges(ring), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))


def ring_centroid(ring: Column) -> Column:
    """struct<x, y>; NULL fields for a ring without area."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    six = F.nullif(6 * signed_area(ring), F.lit(0.0))
    return F.struct((_sum(_edges(ring), lambda p, q: (p["x"] + q["x"]) * cross(p, q)) / six).alias("x"), (_sum(_edges(ring), lambda p, q: (p["y"] + q["y"]) * cross(p, q)) / six).alias("y"))


def compactness(ring: Column) -> Column:
    n = ring_length(ring)
    return 4 * math.pi * ring_area(ring) / F.nullif(n * n, F.lit(0.0))


def dominant_angle(ring: Column) -> Column:
    """Length-weighted circular mean of edge directions modulo 90 degrees, in degrees from -45 to 45."""
    length = lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])
    angle = lambda p, q: F.atan2(q["y"] - p["y"], q["x"] - p["x"])
    return F.degrees(F.atan2(_sum(_edges(ring), lambda p, q: length(p, q) * F.sin(4 * angle(p, q))), _sum(_edges(ring), lambda p, q: length(p, q) * F.cos(4 * angle(p, q)))) / 4)
