"""Connected components of masks, zonal statistics and the candidate mask built from them.

Components are found tile by tile (flood fill inside a tile, Arrow batches per tile) and joined
over tile seams by star steps on the few labels that touch there, so rounds depend on
the number of tiles a component spans, not on its pixels. A label is the component's least
linear pixel index.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import raster as ra
from gridloom.operators.graph import components as graph_components
from gridloom.plans.scratch import written

TILE = 256
WIDTH = 1 << 31


def _label_tile(rows: pd.DataFrame) -> pd.DataFrame:
    r, c = rows["r"].to_numpy().astype(np.int64), rows["c"].to_numpy().astype(np.int64)
    r0, c0 = r.min(), c.min()
    grid = np.full((r.max() - r0 + 1, c.max() - c0 + 1), -1, dtype=np.int64)
    order = np.lexsort((c, r))
    grid[r[order] - r0, c[order] - c0] = np.arange(len(order))
    parent = list(range(len(order)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in ((grid[:, :-1], grid[:, 1:]), (grid[:-1], grid[1:])):
        both = (a >= 0) & (b >= 0)
        for x, y in zip(a[both].tolist(), b[both].tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
    first = np.array([root(i) for i in range(len(order))])
    r, c = r[order], c[order]
    return pd.DataFrame({"r": r.astype(np.int32), "c": c.astype(np.int32), "label": r[first] * WIDTH + c[first]})


def components(mask: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """(r, c, label) of a mask's pixels, 4-connected; label = least r * width + c of the component."""
    tiles = mask.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))
    tiles = tiles.groupBy(F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc"))
    local = written(tiles.applyInPandas(_label_tile, "r int, c int, label long"), "labels")
    seams = []
    for axis, other in (("r", "c"), ("c", "r")):
        low = local.where(F.pmod(F.col(axis), F.lit(tile)) == tile - 1).select((F.col(axis) + 1).alias(axis), other, F.col("label").alias("u"))
        high = local.where(F.pmod(F.col(axis), F.lit(tile)) == 0).select(axis, other, F.col("label").alias("v"))
        seams.append(low.join(high, [axis, other]).select("u", "v"))
    joined = graph_components(seams[0].unionByName(seams[1]))
    final = local.join(joined, F.col("label") == F.col("node"), "left").withColumn("own", F.coalesce("component", "label"))
    return final.select("r", "c", (F.floor(F.col("own") / WIDTH) * width + F.col("own") % WIDTH).cast("long").alias("label"))


def remove_small(mask: DataFrame, least: int, width: int) -> DataFrame:
    """Pixels of components of at least ``least`` pixels."""
    labels = written(components(mask, width), "components")
    large = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return labels.join(large, "label", "left_semi").select("r", "c")


def fill_holes(mask: DataFrame, grid: DataFrame, most: int, width: int) -> DataFrame:
    """The mask with background components of at most ``most`` pixels; those at the border count too."""
    labels = written(components(ra.complement(grid, mask), width), "holes")
    small = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    return mask.select("r", "c").unionByName(labels.join(small, "label", "left_semi").select("r", "c"))


def zonal(labels: DataFrame, values: DataFrame) -> DataFrame:
    """Per label: pixels, valid pixels, sum, mean, extremes, spread, median and 95th percentile of v, and its extent."""
    v = F.col("v")
    return labels.join(values, ["r", "c"], "left").groupBy("label").agg(
        F.count("*").alias("area"), F.count(v).alias("valid"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_pop(v).alias("spread"),
        F.median(v).alias("median"), F.percentile(v, F.lit(0.95)).alias("p95"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"),
    )


def object_filter(labels: DataFrame, px: DataFrame, least_height: float = ra.MIN_OBJECT_HEIGHT, most_rough: float = 99.0, least_smooth: float = 0.0, most_ndvi: float = 1.0, exempt_area: float = 400.0, roof_core: float = 0.0, width: int = WIDTH) -> DataFrame:
    """Labels' pixels whose object is high, smooth and even enough, and not green; h, rough (and ndvi) as in ``px``.

    The green rule is off at ``most_ndvi`` = 1 or without ndvi. Objects of ``exempt_area`` pixels and more are exempt
    from it, and so are those with a smooth patch of ``roof_core`` pixels where that is above 0.
    """
    smooth = F.avg(F.coalesce((F.col("rough") < ra.MAX_ROUGHNESS), F.lit(False)).cast("double"))
    by_ndvi = most_ndvi < 1 and "ndvi" in px.columns
    green = ra.exact_mean("ndvi") > most_ndvi if by_ndvi else F.lit(False)
    stats = labels.join(px.select("r", "c", "h", "rough", *(["ndvi"] if by_ndvi else [])), ["r", "c"]).groupBy("label").agg(F.max("h").alias("top"), F.avg("rough").alias("rough"), smooth.alias("smooth"), F.count("*").alias("n"), F.coalesce(F.first(green) if not by_ndvi else green, F.lit(False)).alias("green"))
    if by_ndvi and roof_core > 0:
        stats = stats.join(largest_smooth_patch(labels, px, width), "label").withColumn("green", F.col("green") & (F.col("patch") < roof_core))
    high = (F.col("top") >= least_height) & (F.coalesce("rough", F.lit(0.0)) <= most_rough) & (F.col("smooth") >= least_smooth)
    return labels.join(stats.where(high & ~(F.col("green") & (F.col("n") < exempt_area))), "label", "left_semi")


def largest_smooth_patch(labels: DataFrame, px: DataFrame, width: int) -> DataFrame:
    """(label, patch): size of the largest smooth component inside each object."""
    smooth = labels.join(px.where(F.col("rough") < ra.MAX_ROUGHNESS).select("r", "c"), ["r", "c"])
    patches = components(smooth, width).withColumnRenamed("label", "patch_label")
    # a patch of touching objects is cut by its owner
    sizes = patches.join(labels, ["r", "c"]).groupBy("label", "patch_label").agg(F.count("*").alias("n"))
    most = sizes.groupBy("label").agg(F.max("n").alias("patch"))
    return labels.select("label").distinct().join(most, "label", "left").select("label", F.coalesce("patch", F.lit(0)).alias("patch"))


def extract_mask(px: DataFrame, width: int, most_ndvi: float = 1.0, exempt_area: float = 400.0, roof_core: float = 0.0) -> DataFrame:
    """(r, c, label) of the candidate mask: seeds, growth inside tall pixels, closing, holes, size and object filters.

    ``px`` has h and rough, and ndvi where the green rule is on. Every stage that is used twice is written.
    """
    px = written(px, "px")
    tall = px.where(F.col("h") > ra.MIN_HEIGHT).select("r", "c")
    seeds = px.where((F.col("h") > ra.MIN_HEIGHT) & (F.col("rough") < ra.MAX_ROUGHNESS)).select("r", "c")
    seeds = remove_small(seeds, ra.MIN_SEED, width)
    grown = written(ra.grow(seeds, tall), "grown")
    closed = written(ra.close3x3(grown, px), "closed")
    filled = fill_holes(closed, px, ra.MAX_HOLE, width)
    objects = written(components(remove_small(written(filled, "filled"), ra.MIN_PIXELS, width), width), "objects")
    return object_filter(objects, px, most_ndvi=most_ndvi, exempt_area=exempt_area, roof_core=roof_core, width=width)
