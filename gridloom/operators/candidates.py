"""Features and training labels of candidate regions (r, c, label), as grouped aggregates and equi-joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import boxes as bx
from gridloom.operators import outlines as ou
from gridloom.operators import raster as ra
from gridloom.operators import regions as re_
from gridloom.plans.scratch import written

NEIGHBOUR_RADIUS = 50.0
#: The directions in which boundary crossings are counted.
DIRECTIONS = ((0, 1), (1, 0), (1, 1), (1, -1))


def moments(labels: DataFrame) -> DataFrame:
    """(label, area, r, c, orientation, major, minor) of every region, from whole-number sums.

    The orientation is the angle between the rows and the long axis; equal spreads give a quarter of a right angle's half turn.
    """
    r, c = F.col("r").cast("long"), F.col("c").cast("long")
    s = labels.groupBy("label").agg(F.count("*").alias("n"), F.sum(r).alias("sr"), F.sum(c).alias("sc"), F.sum(r * r).alias("rr"), F.sum(c * c).alias("cc"), F.sum(r * c).alias("rc"))
    n = F.col("n")
    s = s.select("label", "n", "sr", "sc", (n * F.col("rr") - F.col("sr") * F.col("sr")).alias("vr"), (n * F.col("cc") - F.col("sc") * F.col("sc")).alias("vc"), (n * F.col("rc") - F.col("sr") * F.col("sc")).alias("vx"))
    theta = F.when(F.col("vr") == F.col("vc"), F.when(F.col("vx") > 0, math.pi / 4).otherwise(-math.pi / 4)).otherwise(F.atan2(2.0 * F.col("vx"), (F.col("vr") - F.col("vc")).cast("double")) / 2)
    over = n.cast("double") * n
    half, spread = (F.col("vr") + F.col("vc")) / over / 2 + 1 / 12, F.sqrt(F.pow((F.col("vr") - F.col("vc")) / over / 2, F.lit(2.0)) + F.pow(F.col("vx") / over, F.lit(2.0)))
    axis = lambda x: 4 * F.sqrt(F.greatest(x, F.lit(0.0)))
    return s.select("label", n.alias("area"), (F.col("sr") / n).alias("r"), (F.col("sc") / n).alias("c"), theta.alias("orientation"), axis(half + spread).alias("major"), axis(half - spread).alias("minor"))


def perimeter(labels: DataFrame) -> DataFrame:
    """(label, perimeter): Crofton's from boundary crossings in four directions; a pixel pair inside the region crosses nothing."""
    own = labels.select("label", "r", "c")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(DIRECTIONS)])).alias("o")
    moved = own.select("label", F.col("r"), F.col("c"), steps).select("label", "o.i", (F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c"))
    pairs = moved.join(own, ["label", "r", "c"]).groupBy("label").agg(F.count_if(F.col("i") < 2).alias("straight"), F.count_if(F.col("i") >= 2).alias("diagonal"))
    sizes = own.groupBy("label").agg(F.count("*").alias("n")).join(pairs, "label", "left")
    crossings = lambda c: 4 * F.col("n") - 2 * F.coalesce(c, F.lit(0))
    return sizes.select("label", (math.pi / 4 * (crossings("straight") / 2 + crossings("diagonal") / (2 * math.sqrt(2)))).alias("perimeter"))


def rectangularity(labels: DataFrame, shapes: DataFrame) -> DataFrame:
    """(label, rectangularity): area over the bounding rectangle along the orientation."""
    r, c, t = F.col("r"), F.col("c"), F.col("orientation")
    turned = labels.select("label", "r", "c").join(shapes.select("label", "orientation"), "label").select("label", (r * F.cos(t) + c * F.sin(t)).alias("u"), (c * F.cos(t) - r * F.sin(t)).alias("v"))
    side = lambda x: F.max(x) - F.min(x) + 1
    return turned.groupBy("label").agg((F.count("*") / (side("u") * side("v"))).alias("x")).select("label", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "x")).alias("rectangularity"))


def features(labels: DataFrame, px: DataFrame, width: int, resolution: float = 1.0) -> DataFrame:
    """The features of every region: heights, roughness, NDVI, shape and neighbourhood; ``px`` has h, rough and ndvi."""
    labels = written(labels.select("r", "c", "label"), "candidates")
    px = written(px.select("r", "c", "h", "rough", "ndvi"), "values")
    area = F.count("*") * resolution**2
    smooth = F.avg(F.coalesce(F.col("rough") < ra.MAX_ROUGHNESS, F.lit(False)).cast("double"))
    zones = labels.join(px, ["r", "c"], "left").groupBy("label").agg(
        area.alias("area"), F.avg("h").alias("h_mean"), F.max("h").alias("h_max"), F.stddev_pop("h").alias("h_std"), ra.exact_mean("rough").alias("rough_mean"), F.median("rough").alias("rough_median"),
        smooth.alias("smooth_frac"), ra.exact_mean("ndvi").alias("ndvi_mean"), F.max("ndvi").alias("ndvi_max"), F.min("ndvi").alias("ndvi_min"),
    )
    shapes = written(moments(labels), "moments")
    points = shapes.select(F.col("label").alias("id"), (F.col("c") * resolution).alias("x"), (F.col("r") * resolution).alias("y"))
    around = bx.radius_count(points, NEIGHBOUR_RADIUS).join(bx.nearest_other(points, NEIGHBOUR_RADIUS), "id").withColumnRenamed("id", "label")
    core = re_.largest_smooth_patch(labels, px, width).select("label", (F.col("patch") * resolution**2).alias("smooth_core"))
    solid = ou.outlines(labels).select("label", "solidity")
    # one after the other: together, the driver would hold all their stages and build the smaller ones for every task
    groups = {"zones": zones, "perimeters": perimeter(labels), "rectangles": rectangularity(labels, shapes), "cores": core, "solidity": solid, "around": around.select("label", F.col("neighbours").alias("neighbours_50m"), F.col("nearest").alias("nearest_m"))}
    out = shapes.drop("area")
    for name, group in groups.items():
        out = out.join(written(group, name), "label")
    round_ = F.least(F.lit(1.2), F.greatest(F.lit(0.0), 4 * math.pi * F.col("area") / F.pow(F.col("perimeter") * resolution, F.lit(2.0))))
    return out.withColumns({"slenderness": F.col("h_mean") / F.sqrt("area"), "circularity": round_, "elongation": F.col("minor") / F.nullif(F.col("major"), F.lit(0.0))})


def burned_lines(segments: DataFrame) -> DataFrame:
    """Distinct pixels (r, c) on straight lines (x1, y1, x2, y2) of the pixel grid, one for each step along the longer side."""
    cell = lambda c: F.floor(F.col(c))
    ends = segments.select(cell("x1").alias("c1"), cell("y1").alias("r1"), cell("x2").alias("c2"), cell("y2").alias("r2"))
    steps = F.greatest(F.abs(F.col("c2") - F.col("c1")), F.abs(F.col("r2") - F.col("r1")))
    each = ends.select("*", steps.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), steps)).alias("i"))
    at = lambda a, b: F.floor(F.col(a) + F.col("i") * (F.col(b) - F.col(a)) / F.greatest(F.col("n"), F.lit(1)) + 0.5).cast("int")
    return each.select(at("r1", "r2").alias("r"), at("c1", "c2").alias("c")).distinct()


def line_ratio(labels: DataFrame, segments: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(label, line_ratio): length of lines inside the region, one pixel in from its edge, over the root of its area."""
    inner = ra.erode(labels.select("r", "c"), ra.CROSS).join(burned_lines(segments), ["r", "c"])
    hits = labels.join(inner, ["r", "c"]).groupBy("label").agg(F.count("*").alias("n"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("area"))
    return sizes.join(hits, "label", "left").select("label", (F.coalesce("n", F.lit(0)) * resolution / F.sqrt(F.col("area") * resolution**2)).alias("line_ratio"))


def training_labels(labels: DataFrame, scored: DataFrame, ignored: DataFrame) -> DataFrame:
    """(label, area, scored_px, ignore_px, fp_px, is_building, trainable); masks are tables of pixels, scored ones are not ignored."""
    marks = scored.select("r", "c", F.lit(1).alias("s")).distinct().join(ignored.select("r", "c", F.lit(1).alias("i")).distinct(), ["r", "c"], "full")
    n = labels.join(marks, ["r", "c"], "left").groupBy("label").agg(F.count("*").alias("area"), F.count("s").alias("scored_px"), F.count_if(F.col("s").isNull() & F.col("i").isNotNull()).alias("ignore_px"))
    n = n.withColumn("fp_px", F.col("area") - F.col("scored_px") - F.col("ignore_px"))
    return n.select("*", (F.col("scored_px") > F.col("fp_px")).cast("int").alias("is_building"), (F.col("ignore_px") < 0.5 * F.col("area")).alias("trainable"))


def burned_boxes(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Distinct pixels (r, c) of a grid whose centres lie in boxes."""
    first = lambda c: F.greatest(F.ceil(F.col(c) - 0.5), F.lit(0)).cast("int")
    last = lambda c, n: F.least(F.ceil(F.col(c) - 0.5) - 1, F.lit(n - 1)).cast("int")
    span = lambda a, b, n: F.when(first(a) <= last(b, n), F.sequence(first(a), last(b, n)))
    return boxes.select(F.explode(span("minx", "maxx", width)).alias("c"), "miny", "maxy").select("c", F.explode(span("miny", "maxy", height)).alias("r")).distinct()


def explained(building: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """One row: the share of a building's pixels (r, c) that each stage (tall, seeds, sized, final) keeps, and why it is lost."""
    marked = building.select("r", "c")
    for name, mask in stages.items():
        marked = marked.join(mask.select("r", "c", F.lit(1).alias(name)).distinct(), ["r", "c"], "left")
    shares = marked.agg(*[F.try_divide(F.count(name), F.count("*")).alias(name) for name in stages])
    low = F.when(F.col("tall") >= 0.5, "no smooth roof").otherwise("not tall enough")
    verdict = F.when(F.col("final") >= 0.5, "detected").when(F.col("seeds") == 0, low).when(F.col("sized") < 0.5, "seeds too small / size filter").otherwise("per-footprint filter")
    return shares.withColumn("verdict", verdict)
