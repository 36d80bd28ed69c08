"""Box and line operators over the fixtures, each with the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import boxes as bx
from gridloom.operators import metrics as me
from gridloom.operators import truth as tr
from gridloom.plans.registry import query

S = lambda a, b: f"greatest(least({a}.maxx, {b}.maxx) - greatest({a}.minx, {b}.minx), 0) * greatest(least({a}.maxy, {b}.maxy) - greatest({a}.miny, {b}.miny), 0)"
MEET = "a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy"
AREA = lambda a: f"(({a}.maxx - {a}.minx) * ({a}.maxy - {a}.miny))"
SPLIT = """k AS (SELECT *, (maxx - minx) * (maxy - miny) AS area FROM gt),
 t AS (SELECT *, coalesce(NOT ((description = 'Domestic Outbuilding') OR (description = 'Unknown Building' AND area < 50) OR (description = 'Electricity Sub Station')) AND area >= 30 AND height_relativemax_m >= 3.5, false) AS keep FROM k)"""
@query("gt", sql=f"WITH {SPLIT} SELECT fid, area, keep FROM t")
def q_truth_split(gt: DataFrame) -> DataFrame:
    return tr.split(gt).select("fid", "area", "keep")


_CLASS = "CASE " + " ".join(f"WHEN description IN ({', '.join(repr(k) for k in kinds)}) THEN '{name}'" for name, kinds in tr.CLASSES.items()) + f" ELSE '{tr.OTHER}' END"


@query("gt", sql=f"SELECT fid, {_CLASS} AS class FROM gt")
def q_class_lookup(gt: DataFrame) -> DataFrame:
    return tr.with_class(gt).select("fid", "class")


@query("gt", sql="""WITH k AS (SELECT *, (maxx - minx) * (maxy - miny) AS a FROM gt) SELECT CASE WHEN a < 30 THEN NULL WHEN a < 50 THEN '30-50' WHEN a < 200 THEN '50-200' WHEN a < 1000 THEN '200-1000' ELSE '>1000' END AS band, count(*) AS n, sum(a) AS area FROM k GROUP BY 1""")
def q_size_bands(gt: DataFrame) -> DataFrame:
    return gt.withColumn("a", bx.area()).groupBy(tr.size_band(F.col("a")).alias("band")).agg(F.count("*").alias("n"), F.sum("a").alias("area"))


@query("gt", sql="WITH k AS (SELECT (maxx - minx) * (maxy - miny) AS a FROM gt) SELECT count(*) AS n, min(a) AS least, median(a) AS middle, round(avg(a), 6) AS mean, max(a) AS most, CAST(count_if(a < 30) AS BIGINT) AS under_30, CAST(count_if(a < 50) AS BIGINT) AS under_50 FROM k")
def q_vector_profile(gt: DataFrame) -> DataFrame:
    a = F.col("a")
    return gt.select(bx.area().alias("a")).agg(F.count("*").alias("n"), F.min(a).alias("least"), F.median(a).alias("middle"), F.round(F.avg(a), 6).alias("mean"), F.max(a).alias("most"), F.count_if(a < 30).alias("under_30"), F.count_if(a < 50).alias("under_50"))


@query("gt", sql="""WITH k AS (SELECT *, (maxx - minx) * (maxy - miny) AS a, height_relativemax_m AS h FROM gt) SELECT fid, CASE WHEN description IN ('Domestic Outbuilding', 'Electricity Sub Station') THEN 'ignored (excluded type under inf m2)'
 WHEN description = 'Unknown Building' AND a < 50 THEN 'ignored (excluded type under 50 m2)' WHEN h IS NULL THEN 'ignored (no OS height)' WHEN h < 3.5 THEN 'ignored (OS height ' || h || ' m < 3.5 m)' ELSE 'scored' END AS status FROM k""")
def q_truth_status(gt: DataFrame) -> DataFrame:
    return tr.split(gt).select("fid", tr.status().alias("status"))


@query("gt", "pred", sql=f"SELECT a.fid, b.pid FROM gt a JOIN pred b ON {MEET}")
def q_sjoin_intersects(gt: DataFrame, pred: DataFrame) -> DataFrame:
    return bx.spatial_join(gt, pred).select(F.col("l_fid").alias("fid"), F.col("r_pid").alias("pid"))


@query("gt", "pred", sql=f"SELECT a.fid, b.pid FROM gt a JOIN pred b ON (b.minx + b.maxx) / 2 > a.minx AND (b.minx + b.maxx) / 2 < a.maxx AND (b.miny + b.maxy) / 2 > a.miny AND (b.miny + b.maxy) / 2 < a.maxy")
def q_sjoin_within(gt: DataFrame, pred: DataFrame) -> DataFrame:
    return bx.within_join(bx.centroids(pred), gt).select(F.col("r_fid").alias("fid"), F.col("l_pid").alias("pid"))


@query("gt", "pred", sql=f"SELECT a.fid, b.pid FROM gt a JOIN pred b ON {S('a', 'b')} > 0 AND {S('a', 'b')} < least({AREA('a')}, {AREA('b')})")
def q_sjoin_overlaps(gt: DataFrame, pred: DataFrame) -> DataFrame:
    return bx.overlaps_join(gt, pred).select(F.col("l_fid").alias("fid"), F.col("r_pid").alias("pid"))


@query("gt", sql="SELECT fid, maxx FROM gt WHERE maxx >= 200 AND minx <= 600 AND maxy >= 100 AND miny <= 400")
def q_bbox_scan(gt: DataFrame) -> DataFrame:
    return gt.where("maxx >= 200 and minx <= 600 and maxy >= 100 and miny <= 400").select("fid", "maxx")


@query("gt", sql="SELECT fid, minx, miny FROM gt WHERE least(maxx, 500) > greatest(minx, 125) AND least(maxy, 300) > greatest(miny, 75)")
def q_tile_pruning(gt: DataFrame) -> DataFrame:
    return gt.where("least(maxx, 500) > greatest(minx, 125) and least(maxy, 300) > greatest(miny, 75)").select("fid", "minx", "miny")


@query("gt", "segs", sql="""WITH p AS (SELECT fid, (minx + maxx) / 2 AS x, (miny + maxy) / 2 AS y FROM gt), q AS (SELECT fid, seg_id, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM p, segs),
 u AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) END AS t FROM q),
 d AS (SELECT fid, seg_id, sqrt((x - (x1 + t * dx)) * (x - (x1 + t * dx)) + (y - (y1 + t * dy)) * (y - (y1 + t * dy))) AS d FROM u)
 SELECT fid, arg_min(seg_id, round(d, 6) + seg_id * 1e-12) AS seg_id, round(min(d), 6) AS distance FROM d WHERE d <= 40 GROUP BY fid""")
def q_nearest_within(gt: DataFrame, segs: DataFrame) -> DataFrame:
    points = bx.centroids(gt).select(F.col("fid").alias("id"), "x", "y")
    return bx.nearest_segment(points, segs, 40.0).select(F.col("id").alias("fid"), "seg_id", F.round("distance", 6).alias("distance"))


_PTS = "p AS (SELECT fid, (minx + maxx) / 2 AS x, (miny + maxy) / 2 AS y FROM gt)"


@query("gt", sql=f"WITH {_PTS} SELECT a.fid, count(b.fid) AS neighbours FROM p a LEFT JOIN p b ON a.fid <> b.fid AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 50 GROUP BY a.fid")
def q_radius_count(gt: DataFrame) -> DataFrame:
    return bx.radius_count(bx.centroids(gt).select(F.col("fid").alias("id"), "x", "y")).select(F.col("id").alias("fid"), "neighbours")


@query("gt", sql=f"WITH {_PTS} SELECT a.fid, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS nearest FROM p a JOIN p b ON a.fid <> b.fid GROUP BY a.fid")
def q_nearest_other(gt: DataFrame) -> DataFrame:
    return bx.nearest_other(bx.centroids(gt).select(F.col("fid").alias("id"), "x", "y"), 16.0).select(F.col("id").alias("fid"), F.round("nearest", 6).alias("nearest"))


@query("gt", "pred", sql=f"SELECT b.pid, arg_max(a.fid, {S('a', 'b')} - a.fid * 1e-9) AS fid FROM gt a JOIN pred b ON {S('a', 'b')} > 0 GROUP BY b.pid")
def q_argmax_overlap(gt: DataFrame, pred: DataFrame) -> DataFrame:
    pairs = bx.spatial_join(gt, pred).withColumn("i", bx.overlap_area("l_", "r_")).where("i > 0")
    return pairs.groupBy(F.col("r_pid").alias("pid")).agg(F.max_by("l_fid", F.struct("i", -F.col("l_fid"))).alias("fid"))


@query("gt", "pred", sql=f"SELECT b.pid, round(coalesce(sum({S('a', 'b')}) FILTER (a.fid IS NOT NULL), 0) / any_value({AREA('b')}), 6) AS share FROM pred b LEFT JOIN gt a ON {MEET} GROUP BY b.pid")
def q_overlap_fraction(gt: DataFrame, pred: DataFrame) -> DataFrame:
    return bx.overlap_fraction(pred, "pid", gt).select("pid", F.round("share", 6).alias("share"))



@query("gt", "pred", sql=f"SELECT b.dataset, a.fid, b.pid, round({S('a', 'b')} / ({AREA('a')} + {AREA('b')} - {S('a', 'b')}), 6) AS iou FROM gt a JOIN pred b ON {S('a', 'b')} / ({AREA('a')} + {AREA('b')} - {S('a', 'b')}) >= 0.5")
def q_iou_match(gt: DataFrame, pred: DataFrame) -> DataFrame:
    return bx.iou_pairs(gt, pred).select(F.col("r_dataset").alias("dataset"), F.col("l_fid").alias("fid"), F.col("r_pid").alias("pid"), F.round("iou", 6).alias("iou"))


@query("gt", sql=f"""WITH RECURSIVE e AS (SELECT a.fid AS u, b.fid AS v FROM gt a JOIN gt b ON a.fid <> b.fid AND {MEET}), t AS (SELECT fid AS p, fid AS q FROM gt UNION SELECT t.p, e.v FROM t JOIN e ON e.u = t.q)
 SELECT p AS fid, min(q) AS block FROM t GROUP BY p""")
def q_dissolve_blocks(gt: DataFrame) -> DataFrame:
    return bx.blocks(gt, "fid").select("fid", "block")


_TILES = "t AS (SELECT x * 100.0 AS minx, y * 100.0 AS miny, x * 100.0 + 100 AS maxx, y * 100.0 + 100 AS maxy, CAST(x AS INT) AS tx, CAST(y AS INT) AS ty FROM range(0, 10) a(x), range(0, 13) b(y))"


@query("gt", sql=f"WITH {_TILES} SELECT tx, ty, round(sum({S('a', 'b')}), 6) AS area FROM gt a JOIN t b ON {S('a', 'b')} > 0 GROUP BY tx, ty")
def q_tile_areas(gt: DataFrame) -> DataFrame:
    tiles = gt.sparkSession.range(10).select(F.col("id").cast("int").alias("tx"), F.explode(F.sequence(F.lit(0), F.lit(12))).alias("ty"))
    tiles = tiles.select("tx", "ty", (F.col("tx") * 100.0).alias("minx"), (F.col("ty") * 100.0).alias("miny"), (F.col("tx") * 100.0 + 100).alias("maxx"), (F.col("ty") * 100.0 + 100).alias("maxy"))
    inter = bx.overlap_area("l_", "r_")
    return bx.spatial_join(gt, tiles, 100.0).where(inter > 0).groupBy(F.col("r_tx").alias("tx"), F.col("r_ty").alias("ty")).agg(F.round(F.sum(inter), 6).alias("area"))


@query("pred", sql="""SELECT pid, greatest(minx, 0) AS minx, greatest(miny, 0) AS miny, least(maxx, 1000) AS maxx, least(maxy, 1250) AS maxy FROM pred WHERE least(maxx, 1000) > greatest(minx, 0) AND least(maxy, 1250) > greatest(miny, 0)""")
def q_clip_region(pred: DataFrame) -> DataFrame:
    return bx.clip(pred, 0.0, 0.0, 1000.0, 1250.0).select("pid", "minx", "miny", "maxx", "maxy")


@query("gt", sql="SELECT fid, (CASE WHEN (miny + maxy) / 2 > 625 THEN 'n' ELSE 's' END) || (CASE WHEN (minx + maxx) / 2 > 500 THEN 'e' ELSE 'w' END) AS quadrant, CAST(least(floor((minx + maxx) / 200), 9) AS INT) AS tx, CAST(least(floor((miny + maxy) / 200), 12) AS INT) AS ty FROM gt")
def q_quadrant_key(gt: DataFrame) -> DataFrame:
    p = bx.centroids(gt)
    key = F.concat(F.when(F.col("y") > 625, "n").otherwise("s"), F.when(F.col("x") > 500, "e").otherwise("w"))
    return p.select("fid", key.alias("quadrant"), F.least(F.floor(F.col("x") / 100), F.lit(9)).cast("int").alias("tx"), F.least(F.floor(F.col("y") / 100), F.lit(12)).cast("int").alias("ty"))


@query("gt", "pred", sql=f"""WITH m AS (SELECT b.dataset, a.description, a.height_relativemax_m - (3 + (b.pid % 29) / 4.0) AS e FROM gt a JOIN pred b ON {S('a', 'b')} / ({AREA('a')} + {AREA('b')} - {S('a', 'b')}) >= 0.5 WHERE a.height_relativemax_m IS NOT NULL)
 SELECT dataset, description, count(e) AS n, round(avg(e), 6) AS bias, round(median(abs(e)), 6) AS median_abs, round(avg(abs(e)), 6) AS mean_abs, round(sqrt(avg(e * e)), 6) AS rmse, round(100 * avg(CASE WHEN abs(e) <= 1 THEN 1.0 ELSE 0 END), 6) AS within_1, round(100 * avg(CASE WHEN abs(e) <= 2 THEN 1.0 ELSE 0 END), 6) AS within_2 FROM m GROUP BY GROUPING SETS ((dataset), (dataset, description))""")
def q_height_errors(gt: DataFrame, pred: DataFrame) -> DataFrame:
    # the fixture's footprints have no heights; quarters of a metre by pid stand for measured ones
    m = bx.iou_pairs(gt, pred).where(F.col("l_height_relativemax_m").isNotNull()).select(F.col("r_dataset").alias("dataset"), F.col("l_description").alias("description"), (F.col("l_height_relativemax_m") - (3 + F.col("r_pid") % 29 / 4)).alias("e"))
    out = m.groupingSets([["dataset"], ["dataset", "description"]], "dataset", "description").agg(*me.errors(F.col("e")))
    return out.select("dataset", "description", "n", *[F.round(c, 6).alias(c) for c in ("bias", "median_abs", "mean_abs", "rmse", "within_1", "within_2")])


@query("gt", "pred", sql=f"""WITH {SPLIT}, s AS (SELECT b.pid, coalesce(sum({S('a', 'b')}) FILTER (a.keep), 0) / any_value({AREA('b')}) AS sc, coalesce(sum({S('a', 'b')}) FILTER (NOT a.keep), 0) / any_value({AREA('b')}) AS ig FROM pred b LEFT JOIN t a ON {MEET} GROUP BY b.pid)
 SELECT pid, CASE WHEN sc >= 0.5 THEN 'match' WHEN ig >= 0.5 THEN 'ignore' WHEN sc + ig < 0.1 THEN 'false' ELSE 'partial' END AS label FROM s""")
def q_label_case(gt: DataFrame, pred: DataFrame) -> DataFrame:
    t = tr.split(gt)
    a = bx.overlap_fraction(pred, "pid", t.where("keep")).withColumnRenamed("share", "sc")
    b = bx.overlap_fraction(pred, "pid", t.where("not keep")).withColumnRenamed("share", "ig")
    label = F.when(F.col("sc") >= 0.5, "match").when(F.col("ig") >= 0.5, "ignore").when(F.col("sc") + F.col("ig") < 0.1, "false").otherwise("partial")
    return a.join(b, "pid").select("pid", label.alias("label"))


def _angle() -> Column:
    return F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))


@query("segs", sql="SELECT seg_id, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) AS length, round(degrees(atan2(y2 - y1, x2 - x1)), 6) AS angle FROM segs WHERE NOT (road_function IS NOT DISTINCT FROM 'Motorway') AND (x1 <> x2 OR y1 <> y2)")
def q_segment_roads(segs: DataFrame) -> DataFrame:
    own = segs.where(~F.col("road_function").eqNullSafe(F.lit("Motorway")) & ((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))))
    return own.select("seg_id", F.round(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 6).alias("length"), F.round(F.degrees(_angle()), 6).alias("angle"))


@query("segs", sql="WITH l AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS n, atan2(y2 - y1, x2 - x1) AS a FROM segs) SELECT road_function, round(degrees(atan2(sum(n * sin(4 * a)), sum(n * cos(4 * a))) / 4), 6) AS angle FROM l GROUP BY road_function")
def q_dominant_angle(segs: DataFrame) -> DataFrame:
    l = segs.withColumn("n", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).withColumn("a", _angle())  # noqa: E741
    return l.groupBy("road_function").agg(F.round(F.degrees(F.atan2(F.sum(F.col("n") * F.sin(4 * F.col("a"))), F.sum(F.col("n") * F.cos(4 * F.col("a")))) / 4), 6).alias("angle"))


@query("segs", sql="WITH a AS (SELECT seg_id, degrees(atan2(y2 - y1, x2 - x1)) AS a FROM segs), d AS (SELECT seg_id, (((a - 17.0) % 90) + 90) % 90 AS d FROM a) SELECT seg_id, round(least(d, 90 - d), 6) AS diff FROM d")
def q_angle_diff_90(segs: DataFrame) -> DataFrame:
    d = F.pmod(F.degrees(_angle()) - 17.0, F.lit(90.0))
    return segs.select("seg_id", F.round(F.least(d, 90 - d), 6).alias("diff"))


@query("segs", sql="SELECT seg_id, CAST(greatest(ceil(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / 0.5), 1) AS BIGINT) AS parts FROM segs")
def q_segmentize_count(segs: DataFrame) -> DataFrame:
    n = F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / 0.5)
    points = segs.select("seg_id", F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int"))).alias("i"))
    return points.groupBy("seg_id").agg(F.count("*").alias("parts"))


RING = "(minx miny, maxx miny, maxx maxy, minx maxy)"


def _ring() -> Column:
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return F.array(point("minx", "miny"), point("maxx", "miny"), point("maxx", "maxy"), point("minx", "maxy"), point("minx", "miny"))


@query("gt", sql="SELECT fid, (maxx - minx) * (maxy - miny) AS area, 2 * (maxx - minx + maxy - miny) AS length, (minx + maxx) / 2 AS x, (miny + maxy) / 2 AS y, round(4 * pi() * (maxx - minx) * (maxy - miny) / (4 * (maxx - minx + maxy - miny) * (maxx - minx + maxy - miny)), 6) AS compactness FROM gt")
def q_ring_measures(gt: DataFrame) -> DataFrame:
    from gridloom.functions import rings as rg

    own = gt.withColumn("ring", _ring())
    a, n, c = rg.ring_area(F.col("ring")), rg.ring_length(F.col("ring")), rg.ring_centroid(F.col("ring"))
    return own.select("fid", F.round(a, 6).alias("area"), F.round(n, 6).alias("length"), F.round(c["x"], 6).alias("x"), F.round(c["y"], 6).alias("y"), F.round(4 * math.pi * a / (n * n), 6).alias("compactness"))


@query("gt", sql="""WITH k AS (SELECT CAST(floor((minx + maxx) / 500) AS INT) AS kx, CAST(floor((miny + maxy) / 500) AS INT) AS ky, sum((maxx - minx) * (maxy - miny)) AS area, count(*) FILTER (description = 'Detached House') AS detached, (25 * (max(fid) OVER () // 40 + 1)) / 2 AS mid FROM (SELECT * FROM gt) g GROUP BY kx, ky, fid),
 c AS (SELECT kx, ky, sum(area) AS area, CAST(sum(detached) AS BIGINT) AS detached, any_value(mid) AS mid FROM k GROUP BY kx, ky),
 r AS (SELECT *, row_number() OVER (ORDER BY area, kx, ky) AS a, count(*) OVER () AS m, row_number() OVER (ORDER BY detached DESC, kx, ky) AS h FROM c)
 SELECT 'densest' AS sample, kx, ky FROM r WHERE a = m UNION ALL SELECT 'suburban' AS sample, kx, ky FROM r WHERE a = CAST(floor(m * 0.8) AS INT) + 1 UNION ALL SELECT 'detached' AS sample, kx, ky FROM r WHERE h = 1
 UNION ALL SELECT * FROM (SELECT 'rural' AS sample, kx, ky FROM r WHERE ky * 250 >= mid AND area > 3000 ORDER BY a LIMIT 1) z""")
def q_sample_windows(gt: DataFrame) -> DataFrame:
    middle = 25.0 * (gt.agg(F.max("fid")).first()[0] // 40 + 1) / 2
    return bx.sample_windows(bx.centroids(gt).withColumn("area", bx.area()), 250.0, F.col("description") == "Detached House", middle)


@query("gt", sql="""SELECT fid, CAST(x AS INT) AS c, CAST(y AS INT) AS r FROM (SELECT fid, unnest(range(CAST(ceil(minx - 0.5) AS INT), CAST(ceil(maxx - 0.5) AS INT))) AS x, miny, maxy FROM gt) s, LATERAL (SELECT unnest(range(CAST(ceil(miny - 0.5) AS INT), CAST(ceil(maxy - 0.5) AS INT))) AS y)""")
def q_rasterize_boxes(gt: DataFrame) -> DataFrame:
    cell = lambda a: F.ceil(F.col(a) - 0.5).cast("int")
    span = lambda a, b: F.when(cell(a) < cell(b), F.sequence(cell(a), cell(b) - 1))
    return gt.select("fid", F.explode(span("minx", "maxx")).alias("c"), "miny", "maxy").select("fid", "c", F.explode(span("miny", "maxy")).alias("r"))


@query("gt", "pred", sql=f"SELECT d.dataset, g.fid FROM gt g CROSS JOIN (SELECT DISTINCT dataset FROM pred) d WHERE NOT EXISTS (SELECT 1 FROM gt a JOIN pred b ON {MEET} WHERE a.fid = g.fid AND b.dataset = d.dataset)")
def q_missing_ids(gt: DataFrame, pred: DataFrame) -> DataFrame:
    names = [r[0] for r in pred.select("dataset").distinct().collect()]
    met = bx.spatial_join(gt, pred).select(F.col("r_dataset").alias("dataset"), F.col("l_fid").alias("fid"))
    return gt.select("fid", F.explode(F.array(*[F.lit(n) for n in names])).alias("dataset")).join(met, ["dataset", "fid"], "left_anti")


@query("gt", sql="""WITH k AS (SELECT CASE WHEN miny >= 625 THEN 'n' ELSE 's' END AS half, description, (maxx - minx) * (maxy - miny) AS a FROM gt)
 SELECT half, count(*) FILTER (description = 'Detached House') AS detached_n, round(coalesce(sum(a) FILTER (description = 'Detached House'), 0) / 1000, 3) AS detached_area, count(*) FILTER (description = 'Church') AS church_n, round(sum(a) FILTER (description = 'Church') / 1000, 3) AS church_area FROM k GROUP BY half""")
def q_pivot_metric(gt: DataFrame) -> DataFrame:
    k = gt.select(F.when(F.col("miny") >= 625, "n").otherwise("s").alias("half"), "description", bx.area().alias("a"))
    p = k.groupBy("half").pivot("description", ["Detached House", "Church"]).agg(F.count("a").alias("n"), F.round(F.sum("a") / 1000, 3).alias("area"))
    return p.select("half", F.coalesce("Detached House_n", F.lit(0)).alias("detached_n"), F.coalesce("Detached House_area", F.lit(0.0)).alias("detached_area"), F.coalesce("Church_n", F.lit(0)).alias("church_n"), F.col("Church_area").alias("church_area"))
