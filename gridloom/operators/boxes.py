"""Spatial joins and overlays of axis-aligned boxes (minx, miny, maxx, maxy).

Joins put both sides' boxes into square cells and join on the cell. A pair that shares
several cells is kept in one of them only, that of the lower corner of the two boxes'
intersection, so nothing has to be made distinct afterwards. ``cell`` should be about a
box's size; a crowded cell is an ordinary skewed key, which adaptive execution splits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 64.0


def area(p: str = "") -> Column:
    return (F.col(f"{p}maxx") - F.col(f"{p}minx")) * (F.col(f"{p}maxy") - F.col(f"{p}miny"))


def overlap_area(a: str, b: str) -> Column:
    """Area of the intersection of two boxes, 0 when they only touch or lie apart."""
    w = F.least(F.col(f"{a}maxx"), F.col(f"{b}maxx")) - F.greatest(F.col(f"{a}minx"), F.col(f"{b}minx"))
    h = F.least(F.col(f"{a}maxy"), F.col(f"{b}maxy")) - F.greatest(F.col(f"{a}miny"), F.col(f"{b}miny"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def _cells(df: DataFrame, p: str, cell: float, pad: float = 0.0) -> DataFrame:
    low = lambda c: F.floor((F.col(p + c) - pad) / cell).cast("long")
    high = lambda c: F.floor((F.col(p + c) + pad) / cell).cast("long")
    return df.withColumn("__gx", F.explode(F.sequence(low("minx"), high("maxx")))).withColumn("__gy", F.explode(F.sequence(low("miny"), high("maxy"))))


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select([F.col(c).alias(p + c) for c in df.columns])


def spatial_join(left: DataFrame, right: DataFrame, cell: float = CELL) -> DataFrame:
    """All pairs whose closed boxes intersect; columns get prefixes l_ and r_."""
    a, b = _cells(prefixed(left, "l_"), "l_", cell), _cells(prefixed(right, "r_"), "r_", cell)
    meet = (F.col("l_minx") <= F.col("r_maxx")) & (F.col("r_minx") <= F.col("l_maxx")) & (F.col("l_miny") <= F.col("r_maxy")) & (F.col("r_miny") <= F.col("l_maxy"))
    own = (F.floor(F.greatest("l_minx", "r_minx") / cell) == F.col("__gx")) & (F.floor(F.greatest("l_miny", "r_miny") / cell) == F.col("__gy"))
    return a.join(b, ["__gx", "__gy"]).where(meet & own).drop("__gx", "__gy")


def overlaps_join(left: DataFrame, right: DataFrame, cell: float = CELL) -> DataFrame:
    """Pairs whose interiors meet while neither contains the other."""
    inter = overlap_area("l_", "r_")
    return spatial_join(left, right, cell).where((inter > 0) & (inter < F.least(area("l_"), area("r_"))))


def within_join(points: DataFrame, boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """Pairs of points (x, y) and boxes that hold them strictly; prefixes l_ and r_."""
    a = prefixed(points, "l_").withColumn("__gx", F.floor(F.col("l_x") / cell).cast("long")).withColumn("__gy", F.floor(F.col("l_y") / cell).cast("long"))
    inside = (F.col("l_x") > F.col("r_minx")) & (F.col("l_x") < F.col("r_maxx")) & (F.col("l_y") > F.col("r_miny")) & (F.col("l_y") < F.col("r_maxy"))
    return a.join(_cells(prefixed(boxes, "r_"), "r_", cell), ["__gx", "__gy"]).where(inside).drop("__gx", "__gy")


def overlap_fraction(geoms: DataFrame, key: str, others: DataFrame, cell: float = CELL) -> DataFrame:
    """(key, share): share of each box that disjoint others cover; 0 without a hit."""
    hit = spatial_join(geoms, others, cell).groupBy(F.col(f"l_{key}").alias(key)).agg(F.sum(overlap_area("l_", "r_")).alias("__hit"))
    return geoms.select(key, area().alias("__area")).join(hit, key, "left").select(key, (F.coalesce("__hit", F.lit(0.0)) / F.col("__area")).alias("share"))


def centroids(df: DataFrame) -> DataFrame:
    return df.withColumn("x", (F.col("minx") + F.col("maxx")) / 2).withColumn("y", (F.col("miny") + F.col("maxy")) / 2)


def near_pairs(points: DataFrame, radius: float, asking: DataFrame | None = None) -> DataFrame:
    """Ordered pairs of different points (id, x, y) within ``radius``: each asking point (all by default) meets its own and the eight cells around."""
    a = prefixed(points if asking is None else asking, "l_").withColumn("__gx", F.floor(F.col("l_x") / radius).cast("long")).withColumn("__gy", F.floor(F.col("l_y") / radius).cast("long"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    b = prefixed(points, "r_").withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around))
    b = b.withColumn("__gx", F.floor(F.col("r_x") / radius).cast("long") + F.col("__dx")).withColumn("__gy", F.floor(F.col("r_y") / radius).cast("long") + F.col("__dy"))
    distance = F.hypot(F.col("l_x") - F.col("r_x"), F.col("l_y") - F.col("r_y"))
    pairs = a.join(b, ["__gx", "__gy"]).where(F.col("l_id") != F.col("r_id")).withColumn("distance", distance)
    return pairs.where(F.col("distance") <= radius).select("l_id", "r_id", "distance")


def radius_count(points: DataFrame, radius: float = 50.0) -> DataFrame:
    """(id, neighbours): other points within ``radius``."""
    counts = near_pairs(points, radius).groupBy(F.col("l_id").alias("id")).agg(F.count("*").alias("n"))
    return points.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("neighbours"))


def nearest_other(points: DataFrame, radius: float = 64.0, rounds: int = 24) -> DataFrame:
    """(id, nearest): distance to the closest other point, NULL when there is none.

    The radius doubles for the points that found nothing yet, and stops when all have found or
    the radius spans the whole extent.
    """
    from gridloom.plans.scratch import written

    points = written(points.select("id", "x", "y"), "points")
    size = points.agg(F.max(F.col("x")) - F.min(F.col("x")), F.max(F.col("y")) - F.min(F.col("y"))).first()
    extent = math.hypot(float(size[0] or 0), float(size[1] or 0))
    left, out = points, None
    for _ in range(rounds):
        found = written(near_pairs(points, radius, left).groupBy(F.col("l_id").alias("id")).agg(F.min("distance").alias("nearest")), "nearest")
        out = found if out is None else out.unionByName(found)
        left = written(left.join(found, "id", "left_anti"), "open")
        if radius > extent or left.isEmpty():
            break
        radius *= 2
    return points.select("id").join(out, "id", "left")


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment; a zero-length segment is its point."""
    dx, dy = x2 - x1, y2 - y1
    squared = dx * dx + dy * dy
    t = F.when(squared == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / F.when(squared == 0, 1.0).otherwise(squared))))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def nearest_segment(points: DataFrame, segments: DataFrame, most: float, cell: float = CELL) -> DataFrame:
    """(id, seg_id, distance): the closest segment within ``most``; the smaller id on ties."""
    boxed = segments.select("seg_id", "x1", "y1", "x2", "y2", F.least("x1", "x2").alias("minx"), F.greatest("x1", "x2").alias("maxx"), F.least("y1", "y2").alias("miny"), F.greatest("y1", "y2").alias("maxy"))
    a = points.withColumn("__gx", F.floor(F.col("x") / cell).cast("long")).withColumn("__gy", F.floor(F.col("y") / cell).cast("long"))
    pairs = a.join(_cells(boxed, "", cell, most), ["__gx", "__gy"])
    pairs = pairs.withColumn("distance", segment_distance(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))).where(F.col("distance") <= most)
    first = Window.partitionBy("id").orderBy("distance", "seg_id")
    return pairs.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("id", "seg_id", "distance")


def clip(df: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Boxes cut to a region; what lies outside or only touches goes."""
    cut = df.withColumns({"minx": F.greatest("minx", F.lit(minx)), "miny": F.greatest("miny", F.lit(miny)), "maxx": F.least("maxx", F.lit(maxx)), "maxy": F.least("maxy", F.lit(maxy))})
    return cut.where((F.col("maxx") > F.col("minx")) & (F.col("maxy") > F.col("miny")))


def blocks(df: DataFrame, key: str, cell: float = CELL, same: str | None = None) -> DataFrame:
    """(key, block): boxes that touch or meet (and are equal in ``same``) share a block, named by its least key."""
    from gridloom.operators.graph import components

    pairs = spatial_join(df, df, cell).where(F.col(f"l_{key}") < F.col(f"r_{key}"))
    if same is not None:
        pairs = pairs.where(F.col(f"l_{same}") == F.col(f"r_{same}"))
    joined = components(pairs.select(F.col(f"l_{key}").cast("long").alias("u"), F.col(f"r_{key}").cast("long").alias("v")))
    return df.select(key).join(joined, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("block"))


def unit_cells(df: DataFrame) -> DataFrame:
    """Distinct unit lattice cells (ux, uy) of boxes with whole-number corners: the union as a set."""
    x = F.explode(F.sequence(F.col("minx").cast("int"), (F.col("maxx") - 1).cast("int"))).alias("ux")
    y = F.explode(F.sequence(F.col("miny").cast("int"), (F.col("maxy") - 1).cast("int"))).alias("uy")
    return df.select("miny", "maxy", x).select("ux", y).distinct()


def iou_pairs(left: DataFrame, right: DataFrame, least: float = 0.5, cell: float = CELL) -> DataFrame:
    """Joined pairs whose intersection over union is at least ``least``, with it as ``iou``."""
    inter = overlap_area("l_", "r_")
    return spatial_join(left, right, cell).withColumn("iou", inter / (area("l_") + area("r_") - inter)).where(F.col("iou") >= least)


def sample_windows(buildings: DataFrame, size: float, detached: Column, middle: float) -> DataFrame:
    """(sample, kx, ky): the cells of largest built area, of its 80th percentile by rank, of most detached houses, and the first one north of ``middle`` with over 3,000.

    ``buildings`` has x, y and area. The windows run over one row for each cell.
    """
    cell = lambda c, name: F.floor(F.col(c) / size).cast("int").alias(name)
    cells = buildings.groupBy(cell("x", "kx"), cell("y", "ky")).agg(F.sum("area").alias("area"), F.count_if(detached).alias("detached"))
    by_area, every = Window.orderBy("area", "kx", "ky"), Window.partitionBy(F.lit(1))
    r = cells.withColumns({"a": F.row_number().over(by_area), "m": F.count("*").over(every), "h": F.row_number().over(Window.orderBy(F.col("detached").desc(), "kx", "ky"))})
    pick = lambda name, rows: rows.select(F.lit(name).alias("sample"), "kx", "ky")
    rural = r.where((F.col("ky") * size >= middle) & (F.col("area") > 3000)).agg(F.min_by(F.struct("kx", "ky"), "a").alias("k")).where("k is not null").select("k.*")
    named = pick("densest", r.where("a = m")).unionByName(pick("suburban", r.where(F.col("a") == F.floor(F.col("m") * 0.8) + 1)))
    return named.unionByName(pick("detached", r.where("h = 1"))).unionByName(pick("rural", rural))


def lines_in(lines: DataFrame, minx: float, miny: float, maxx: float, maxy: float, margin: float = 0.0) -> DataFrame:
    """Lines (x1, y1, x2, y2) whose bounds meet a box widened by ``margin``."""
    meets = (F.greatest("x1", "x2") >= minx - margin) & (F.least("x1", "x2") <= maxx + margin) & (F.greatest("y1", "y2") >= miny - margin) & (F.least("y1", "y2") <= maxy + margin)
    return lines.where(meets)
