"""Means that lie on a limit or on a rounding tie."""

from gridloom.operators import raster as ra
from gridloom.operators import regions


def sum_in_order(values):
    total = 0.0
    for v in values:
        total += v
    return total


def test_mean_ndvi_on_the_limit(spark):
    """A mean that is the limit is not above it, whichever order its pixels come in."""
    pixels = [(0, i, 4.0, 2.0, 0.6 if i < 50 else 0.0) for i in range(60)]
    assert sum_in_order([p[4] for p in pixels]) / 60 > 0.5
    for rows in (pixels, pixels[::-1]):
        px = spark.createDataFrame(rows, "r int, c int, h double, rough double, ndvi double").coalesce(1)
        labels = px.selectExpr("r", "c", "0L AS label")
        assert regions.object_filter(labels, px, most_ndvi=0.5, roof_core=20.0, width=100).count() == 60


def test_exact_mean(spark):
    """62 of 64 pixels at 0.1: the mean 0.096875 is a tie at five digits and must not fall under it."""
    values = [0.1] * 62 + [0.0] * 2
    assert sum_in_order(values) / 64 < 0.096875
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").coalesce(1)
    assert df.agg(ra.exact_mean("v")).first()[0] == 0.096875
    assert df.where("v > 1").agg(ra.exact_mean("v")).first()[0] is None
