"""The truth layer: what is scored, classes and size bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the truth layer's rules.
MIN_HEIGHT, MIN_AREA = 3.5, 30.0
EXCLUDED = {"Domestic Outbuilding": float("inf"), "Unknown Building": 50.0, "Electricity Sub Station": float("inf")}
CLASSES = {
    "terraced/semi house": ("Mid-Terrace House", "End-Of-Terrace House", "Semi-Detached House"),
    "detached house": ("Detached House",),
    "flats/other residential": ("Multiple Residential Accommodation", "Residential Building", "Static Caravan Or Mobile Home", "Temporary Or Holiday Accommodation Building"),
    "outbuilding/unknown": ("Domestic Outbuilding", "Unknown Building", "Ancillary Building"),
    "commercial/mixed use": ("Commercial Building", "Mixed Use Building"),
    "small utility": ("Electricity Sub Station", "Gas Governor", "Pumping Station", "Utility Building", "Waste Water Treatment Works", "Water Distribution Facility", "Electricity Distribution Facility"),
}
OTHER = "public/other"
BANDS = ((30.0, "30-50"), (50.0, "50-200"), (200.0, "200-1000"), (1000.0, ">1000"))


def split(truth: DataFrame) -> DataFrame:
    """Adds area and keep: not an excluded type below its limit, large and high enough; a missing height is not kept."""
    own = truth.withColumn("area", (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")))
    limits = F.create_map(*[x for k, v in EXCLUDED.items() for x in (F.lit(k), F.lit(v))])
    excluded = F.coalesce(F.col("area") < F.try_element_at(limits, F.col("description")), F.lit(False))
    keep = ~excluded & (F.col("area") >= MIN_AREA) & (F.col("height_relativemax_m") >= MIN_HEIGHT)
    return own.withColumn("keep", F.coalesce(keep, F.lit(False)))


def with_class(truth: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for name, types in CLASSES.items() for kind in types for x in (kind, name)])
    return truth.withColumn("class", F.coalesce(F.try_element_at(names, F.col("description")), F.lit(OTHER)))


def size_band(area: Column) -> Column:
    """Left-closed bands; NULL below the first."""
    out = F.lit(None).cast("string")
    for least, name in BANDS:
        out = F.when(area >= least, name).otherwise(out)
    return out


def status() -> Column:
    """Readable reason of a split row's status: its type's limit first, then its height."""
    h = F.col("height_relativemax_m")
    limits = F.create_map(*[F.lit(x) for kind, least in EXCLUDED.items() for x in (kind, f"{least:g}")])
    areas = F.create_map(*[x for kind, least in EXCLUDED.items() for x in (F.lit(kind), F.lit(least))])
    limited = F.col("area") < F.try_element_at(areas, F.col("description"))
    too_low = F.concat(F.lit("ignored (OS height "), h.cast("string"), F.lit(f" m < {MIN_HEIGHT} m)"))
    return F.when(limited, F.concat(F.lit("ignored (excluded type under "), F.try_element_at(limits, F.col("description")), F.lit(" m2)"))).when(h.isNull(), "ignored (no OS height)").when(h < MIN_HEIGHT, too_low).otherwise("scored")
