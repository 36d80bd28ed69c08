"""Operators on pixel tables (r, c, value): one row per pixel of a dense grid, NULL for nodata.

Neighbourhoods are windows along rows and along columns (separable), so a pixel meets only
its own line; masks are tables of their True pixels, and mask algebra is semi and anti joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_HEIGHT, MAX_ROUGHNESS, MIN_SEED, GROW, MAX_HOLE, MIN_PIXELS, MIN_OBJECT_HEIGHT = 2.5, 1.25, 10, 4, 10, 20, 3.5
CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
SQUARE = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1))


def ndsm(px: DataFrame) -> DataFrame:
    """Adds h = dsm - dtm; NULL where either is NULL."""
    return px.withColumn("h", F.col("dsm") - F.col("dtm"))


def laplacian(px: DataFrame, value: str = "dsm") -> DataFrame:
    """Adds lap: the 4-neighbour Laplacian with half-sample reflection at the grid's edges; NULL beside NULL."""
    v = F.col(value)
    down, across = Window.partitionBy("c").orderBy("r"), Window.partitionBy("r").orderBy("c")
    edge = lambda w, f: F.when(F.row_number().over(w) == 1, v).otherwise(f)
    up_r, up_c = Window.partitionBy("c").orderBy(F.col("r").desc()), Window.partitionBy("r").orderBy(F.col("c").desc())
    total = edge(down, F.lag(v).over(down)) + edge(up_r, F.lead(v).over(down)) + edge(across, F.lag(v).over(across)) + edge(up_c, F.lead(v).over(across))
    return px.withColumn("lap", total - 4 * v)


def moving_mean(px: DataFrame, value: Column, out: str, radius: int = 2) -> DataFrame:
    """Adds the mean over a square of pixels; NULLs and what lies outside the grid don't count.

    Separable: sums and counts along columns, then along rows.
    """
    down = Window.partitionBy("c").orderBy("r").rowsBetween(-radius, radius)
    across = Window.partitionBy("r").orderBy("c").rowsBetween(-radius, radius)
    sums = px.withColumns({"__s": F.sum(value).over(down), "__n": F.count(value).over(down)})
    return sums.withColumn(out, F.sum("__s").over(across) / F.nullif(F.sum("__n").over(across), F.lit(0))).drop("__s", "__n")


def exact_mean(value: str) -> Column:
    """The mean of values to nine digits, added up exactly, so that the order of pixels can't move it over a limit or a rounding tie."""
    return F.try_divide(F.sum(F.col(value).cast("decimal(18,9)")).cast("double"), F.count(value))


def roughness(px: DataFrame) -> DataFrame:
    """Adds rough: the 5 x 5 mean of the absolute Laplacian."""
    return moving_mean(laplacian(px), F.abs("lap"), "rough")


def dilate(mask: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    """Distinct pixels (r, c) that an offset reaches from the mask."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets]))
    return mask.select("r", "c", steps.alias("o")).select((F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c")).distinct()


def erode(mask: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    """Pixels all of whose offsets lie in the mask; outside the grid is outside the mask."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets]))
    moved = mask.select("r", "c", steps.alias("o")).select((F.col("r") - F.col("o.a")).alias("r"), (F.col("c") - F.col("o.b")).alias("c"))
    return moved.groupBy("r", "c").agg(F.count("*").alias("n")).where(F.col("n") == len(offsets)).select("r", "c")


def grow(seeds: DataFrame, mask: DataFrame, rounds: int = GROW) -> DataFrame:
    """Geodesic dilation: ``rounds`` 4-neighbour steps, each kept inside the mask."""
    out = seeds
    for _ in range(rounds):
        out = dilate(out, CROSS).join(mask.select("r", "c"), ["r", "c"], "left_semi")
    return out


def close3x3(mask: DataFrame, grid: DataFrame) -> DataFrame:
    """Binary closing by a 3 x 3 square; outside the grid is False, so the outermost ring is cleared."""
    return erode(dilate(mask, SQUARE).join(grid.select("r", "c"), ["r", "c"], "left_semi"), SQUARE)


def open_disk(mask: DataFrame, radius: int) -> DataFrame:
    """Binary opening by a disk: erosion, then dilation."""
    disk = tuple((a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius)
    return dilate(erode(mask, disk), disk)


def complement(grid: DataFrame, mask: DataFrame) -> DataFrame:
    return grid.select("r", "c").join(mask.select("r", "c"), ["r", "c"], "left_anti")


def window(px: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Windowed scan: the rectangle r0 <= r < r1, c0 <= c < c1, as plain filters."""
    return px.where((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))


def boundless_window(px: DataFrame, value: str, r0: int, r1: int, c0: int, c1: int, fill: float = 0.0) -> DataFrame:
    """The whole rectangle, with ``fill`` where the grid has no value."""
    spark = px.sparkSession
    full = spark.range(r0, r1).select(F.col("id").cast("int").alias("r"), F.explode(F.sequence(F.lit(c0), F.lit(c1 - 1))).alias("c"))
    return full.join(window(px, r0, r1, c0, c1).select("r", "c", value), ["r", "c"], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def upsample(px: DataFrame, value: str, factor: int) -> DataFrame:
    """Bilinear resampling to ``factor`` times the resolution, clamped at the edges.

    Every coarse pixel sends its value to the fine pixels it has weight in, so the work is one
    grouped sum; NULL sources make NULL.
    """
    size = px.agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w")).first()
    out = px.select("r", "c", F.col(value).alias("v"))
    for axis, n in (("r", size["h"]), ("c", size["w"])):
        fine = F.explode(F.sequence(F.greatest(F.col(axis) * factor - factor, F.lit(0)), F.least(F.col(axis) * factor + 2 * factor - 1, F.lit(n * factor - 1)))).alias("f")
        place = F.least(F.greatest((F.col("f") + 0.5) / factor - 0.5, F.lit(0.0)), F.lit(float(n - 1)))
        weight = 1 - F.abs(place - F.col(axis))
        other = "c" if axis == "r" else "r"
        sent = out.select(axis, other, "v", fine).withColumn("w", weight).where(F.col("w") > 0)
        value_ = F.when(F.count_if(F.col("v").isNull()) == 0, F.sum(F.col("v") * F.col("w"))).alias("v")
        out = sent.groupBy(F.col("f").alias(axis), other).agg(value_)
    return out.select("r", "c", F.col("v").alias(value))


def mosaic(tiles: DataFrame) -> DataFrame:
    """(r, c, v): the first non-NULL value in order of tile."""
    return tiles.groupBy("r", "c").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("tile"))).alias("v"))


def reflectance(dn: Column, offset: Column) -> Column:
    """Digital number to reflectance; 0 is nodata."""
    return F.when(dn != 0, (dn - offset) / F.lit(10000.0))


def ndvi(nir: Column, red: Column) -> Column:
    return F.try_divide(nir - red, nir + red)


MIN_CLEAR = 0.6


def clear_scenes(obs: DataFrame, classes: Sequence[int], least: float = MIN_CLEAR) -> DataFrame:
    """(scene, clear): scenes whose share of clear observations is at least ``least``."""
    return obs.groupBy("scene").agg(F.avg(F.col("scl").isin(*classes).cast("double")).alias("clear")).where(F.col("clear") >= least)


def neutral_ndvi(value: Column) -> Column:
    """NDVI with nodata (below -1) as 0."""
    return F.when(value < -1, 0.0).otherwise(value)


def search_scenes(scenes: DataFrame, first: str, last: str, cloud: float, box: tuple[float, float, float, float]) -> DataFrame:
    """Scenes (day, cloud, minx..maxy) of a range of days under a cloud limit that meet a box, with their ``turn`` in time; plain filters that reach the scan."""
    minx, miny, maxx, maxy = box
    meets = (F.col("maxx") >= minx) & (F.col("minx") <= maxx) & (F.col("maxy") >= miny) & (F.col("miny") <= maxy)
    found = scenes.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & (F.col("cloud") < cloud) & meets)
    return found.withColumn("turn", F.row_number().over(Window.orderBy("day", "scene")).cast("long"))


def map_x(c: Column, origin: float, resolution: float) -> Column:
    """Map coordinate of a column's centre."""
    return F.lit(origin) + (c + 0.5) * resolution


def map_y(r: Column, origin: float, resolution: float) -> Column:
    """Map coordinate of a row's centre; row 0 is the northernmost."""
    return F.lit(origin) - (r + 0.5) * resolution


def pixel_at(x: Column, y: Column, west: float, north: float, resolution: float) -> tuple[Column, Column]:
    """(row, column) of the pixel that holds a map coordinate."""
    return F.floor((F.lit(north) - y) / resolution).cast("int"), F.floor((x - F.lit(west)) / resolution).cast("int")
