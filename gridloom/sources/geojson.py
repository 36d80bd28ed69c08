"""GeoJSON lines and CSV reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature(ring: Column, properties: Sequence[str]) -> Column:
    """A polygon feature as JSON text, coordinates rounded to six decimals."""
    points = F.transform(ring, lambda p: F.array(F.round(p["x"], 6), F.round(p["y"], 6)))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")))


def write_features(df: DataFrame, ring: str, properties: Sequence[str], path: str) -> None:
    """One feature for each line."""
    df.select(feature(F.col(ring), properties).alias("value")).write.mode("overwrite").text(path)


def write_report(df: DataFrame, digits: int, path: str) -> None:
    """CSV with a header; doubles rounded."""
    df.select([F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").csv(path, header=True)
