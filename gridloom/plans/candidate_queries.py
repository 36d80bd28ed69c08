"""Candidate features, labels and reports over the fixtures, each with the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import boxes as bx
from gridloom.operators import candidates as ca
from gridloom.operators import metrics as me
from gridloom.operators import raster as ra
from gridloom.operators import regions as re_
from gridloom.operators import truth as tr
from gridloom.plans.raster_queries import RO_W, TALL, WIDTH, labels_sql
from gridloom.plans.registry import query
from gridloom.plans.scratch import written

#: An NDVI for the pixel fixture, nodata below -1 at some.
_NDVI = "CASE WHEN (r * 31 + c * 17) % 29 = 0 THEN -9999.0 ELSE ((floor(r / 10) * 7 + floor(c / 10) * 5) % 20) / 20.0 END"
ND = f"nd AS (SELECT r, c, CASE WHEN v < -1 THEN 0.0 ELSE v END AS ndvi FROM (SELECT r, c, CAST({_NDVI} AS DOUBLE) AS v FROM px) z)"
LABELS = f"{TALL}, {labels_sql('tall', 'lab')}"
SCORED = "(SELECT *, (maxx - minx) * (maxy - miny) AS area FROM gt)"
_KEPT = "coalesce(NOT ((description = 'Domestic Outbuilding') OR (description = 'Unknown Building' AND area < 50) OR (description = 'Electricity Sub Station')) AND area >= 30 AND height_relativemax_m >= 3.5, false)"
BURNED = f"""tt AS (SELECT *, {_KEPT} AS keep FROM {SCORED} z), bp AS (SELECT keep, x, y FROM (SELECT *, unnest(range(CAST(ceil(minx - 0.5) AS INT), CAST(ceil(maxx - 0.5) AS INT))) AS x FROM tt WHERE minx < 100) s, LATERAL (SELECT unnest(range(CAST(ceil(miny - 0.5) AS INT), CAST(ceil(maxy - 0.5) AS INT))) AS y)),
 sc AS (SELECT DISTINCT y AS r, x AS c FROM bp WHERE keep AND x < 100), ig AS (SELECT DISTINCT y AS r, x AS c FROM bp WHERE NOT keep AND x < 100)"""


def _labels(px: DataFrame) -> DataFrame:
    return re_.components(ra.ndsm(px).where(F.col("h") > ra.MIN_HEIGHT).select("r", "c"), WIDTH)


def _with_ndvi(px: DataFrame) -> DataFrame:
    return px.withColumn("ndvi", ra.neutral_ndvi(F.expr(f"CAST({_NDVI} AS DOUBLE)")))


def _values(px: DataFrame) -> DataFrame:
    return _with_ndvi(ra.roughness(ra.ndsm(px)))


@query("px", sql=f"WITH {ND} SELECT r, c, ndvi FROM nd")
def q_neutral_ndvi(px: DataFrame) -> DataFrame:
    return _with_ndvi(px).select("r", "c", "ndvi")


MOM = """mo AS (SELECT label, count(*) AS n, sum(r) AS sr, sum(c) AS sc, count(*) * sum(r * r) - sum(r) * sum(r) AS vr, count(*) * sum(c * c) - sum(c) * sum(c) AS vc, count(*) * sum(r * c) - sum(r) * sum(c) AS vx FROM (SELECT label, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c FROM lab) z GROUP BY label),
 mt AS (SELECT *, CASE WHEN vr = vc THEN CASE WHEN vx > 0 THEN pi() / 4 ELSE -pi() / 4 END ELSE atan2(2.0 * vx, CAST(vr - vc AS DOUBLE)) / 2 END AS theta, (vr + vc) / (n * n) / 2 + 1 / 12 AS half, sqrt(pow((vr - vc) / (n * n) / 2, 2) + pow(vx / (n * n), 2)) AS spread FROM mo),
 ma AS (SELECT label, n, sr / n AS r, sc / n AS c, theta, 4 * sqrt(half + spread) AS major, 4 * sqrt(greatest(half - spread, 0)) AS minor FROM mt)"""
PER = f"""pr AS (SELECT a.label, count(*) FILTER (o.i < 2) AS st, count(*) FILTER (o.i >= 2) AS di FROM lab a, (VALUES (0, 0, 1), (1, 1, 0), (2, 1, 1), (3, 1, -1)) o(i, a, b), lab b WHERE b.label = a.label AND b.r = a.r + o.a AND b.c = a.c + o.b GROUP BY a.label),
 pe AS (SELECT ma.label, {math.pi / 4!r} * ((4 * n - 2 * coalesce(st, 0)) / 2 + (4 * n - 2 * coalesce(di, 0)) / {2 * math.sqrt(2)!r}) AS perimeter FROM ma LEFT JOIN pr USING (label))"""
REC = "re AS (SELECT label, least(1.0, greatest(0.0, count(*) / ((max(u) - min(u) + 1) * (max(v) - min(v) + 1)))) AS rectangularity FROM (SELECT lab.label, lab.r * cos(theta) + lab.c * sin(theta) AS u, lab.c * cos(theta) - lab.r * sin(theta) AS v FROM lab JOIN ma USING (label)) z GROUP BY label)"
_SHAPE = ("area", "orientation", "major", "minor", "perimeter", "circularity", "elongation", "rectangularity")


@query("px", sql=f"WITH RECURSIVE {LABELS}, {MOM}, {PER}, {REC} SELECT label, CAST(n AS DOUBLE) AS area, round(theta, 6) AS orientation, round(major, 6) AS major, round(minor, 6) AS minor, round(perimeter, 6) AS perimeter, round(least(1.2, greatest(0, 4 * pi() * n / (perimeter * perimeter))), 6) AS circularity, round(minor / nullif(major, 0), 6) AS elongation, round(rectangularity, 6) AS rectangularity FROM ma JOIN pe USING (label) JOIN re USING (label)")
def q_shape_features(px: DataFrame) -> DataFrame:
    labels = written(_labels(px), "labels")
    m = written(ca.moments(labels), "moments")
    out = m.join(ca.perimeter(labels), "label").join(ca.rectangularity(labels, m), "label").withColumn("area", F.col("area").cast("double"))
    out = out.withColumns({"circularity": F.least(F.lit(1.2), F.greatest(F.lit(0.0), 4 * math.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter")))), "elongation": F.col("minor") / F.nullif(F.col("major"), F.lit(0.0))})
    return out.select("label", *[F.round(c, 6).alias(c) for c in _SHAPE])


_FEATURES = ("area", "h_mean", "h_max", "h_std", "slenderness", "rough_mean", "rough_median", "smooth_frac", "smooth_core", "ndvi_mean", "ndvi_max", "ndvi_min", "circularity", "elongation", "rectangularity", "nearest_m")
FEAT = f"""{RO_W}, {ND}, {MOM}, {PER}, {REC}, sm AS (SELECT r, c FROM tall JOIN ro USING (r, c) WHERE rough < 1.25), {labels_sql('sm', 'pat')},
 co AS (SELECT label, max(n) AS core FROM (SELECT lab.label, pat.label AS patch, count(*) AS n FROM lab JOIN pat USING (r, c) GROUP BY ALL) z GROUP BY label),
 zo AS (SELECT label, CAST(count(*) AS DOUBLE) AS area, avg(h) AS h_mean, max(h) AS h_max, stddev_pop(h) AS h_std, CAST(sum(CAST(rough AS DECIMAL(18, 9))) AS DOUBLE) / count(rough) AS rough_mean, median(rough) AS rough_median, avg(CASE WHEN rough < 1.25 THEN 1.0 ELSE 0.0 END) AS smooth_frac, avg(ndvi) AS ndvi_mean, max(ndvi) AS ndvi_max, min(ndvi) AS ndvi_min FROM lab LEFT JOIN h USING (r, c) LEFT JOIN ro USING (r, c) LEFT JOIN nd USING (r, c) GROUP BY label),
 ne AS (SELECT a.label, count(*) FILTER (sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) <= 50) AS neighbours_50m, min(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))) AS nearest_m FROM ma a JOIN ma b ON a.label <> b.label GROUP BY a.label)"""


@query("px", sql=f"WITH RECURSIVE {LABELS}, {FEAT}, f AS (SELECT zo.*, h_mean / sqrt(area) AS slenderness, CAST(coalesce(core, 0) AS DOUBLE) AS smooth_core, least(1.2, greatest(0, 4 * pi() * area / (perimeter * perimeter))) AS circularity, minor / nullif(major, 0) AS elongation, rectangularity, neighbours_50m, nearest_m FROM zo JOIN ma USING (label) JOIN pe USING (label) JOIN re USING (label) LEFT JOIN co USING (label) JOIN ne USING (label)) SELECT label, neighbours_50m, {', '.join(f'round({c}, 5) AS {c}' for c in _FEATURES)} FROM f")
def q_candidate_features(px: DataFrame) -> DataFrame:
    return ca.features(_labels(px), _values(px), WIDTH).select("label", "neighbours_50m", *[F.round(c, 5).alias(c) for c in _FEATURES])


@query("px", "gt", sql=f"WITH RECURSIVE {LABELS}, {BURNED}, n AS (SELECT label, count(*) AS area, count(sc.r) AS scored_px, count(ig.r) FILTER (sc.r IS NULL) AS ignore_px FROM lab LEFT JOIN sc USING (r, c) LEFT JOIN ig USING (r, c) GROUP BY label) SELECT *, area - scored_px - ignore_px AS fp_px, CASE WHEN scored_px > area - scored_px - ignore_px THEN 1 ELSE 0 END AS is_building, ignore_px < 0.5 * area AS trainable FROM n")
def q_training_labels(px: DataFrame, gt: DataFrame) -> DataFrame:
    return _labelled(px, gt)[1]


def _labelled(px: DataFrame, gt: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions, their training labels and the scored pixels of the grid."""
    height = px.agg(F.max("r")).first()[0] + 1
    labels, t = written(_labels(px), "labels"), tr.split(gt)
    scored = written(ca.burned_boxes(t.where("keep"), WIDTH, height), "scored")
    return labels, ca.training_labels(labels, scored, ca.burned_boxes(t.where("not keep"), WIDTH, height)), scored


_HALF = "CASE WHEN {r} < 75 THEN 'n' ELSE 's' END || CASE WHEN {c} < 50 THEN 'w' ELSE 'e' END"


@query("px", "gt", sql=f"WITH RECURSIVE {LABELS}, {BURNED}, n AS (SELECT label, {_HALF.format(r='avg(r)', c='avg(c)')} AS quadrant, count(*) AS area, count(sc.x) AS scored_px, count(ig.x) FILTER (sc.x IS NULL) AS ignore_px FROM lab LEFT JOIN (SELECT r, c, 1 AS x FROM sc) sc USING (r, c) LEFT JOIN (SELECT r, c, 1 AS x FROM ig) ig USING (r, c) GROUP BY label), t AS (SELECT {_HALF.format(r='r', c='c')} AS quadrant, count(*) AS truth FROM sc JOIN px USING (r, c) GROUP BY ALL), k AS (SELECT quadrant, coalesce(CAST(sum(scored_px) FILTER (area >= 30) AS BIGINT), 0) AS tp, coalesce(CAST(sum(area - scored_px - ignore_px) FILTER (area >= 30) AS BIGINT), 0) AS fp FROM n GROUP BY quadrant) SELECT quadrant, tp, fp, truth - tp AS fn, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision, round(tp / truth, 6) AS recall, round(CASE WHEN tp + fp + truth = 0 THEN 0.0 ELSE 2.0 * tp / (tp + fp + truth) END, 6) AS f1 FROM k JOIN t USING (quadrant)")
def q_pixel_scores(px: DataFrame, gt: DataFrame) -> DataFrame:
    labels, own, scored = _labelled(px, gt)
    half = lambda r, c: F.concat(F.when(r < 75, "n").otherwise("s"), F.when(c < 50, "w").otherwise("e")).alias("quadrant")
    placed = own.join(ca.moments(labels).select("label", half(F.col("r"), F.col("c"))), "label")
    totals = scored.join(px.select("r", "c"), ["r", "c"]).groupBy(half(F.col("r"), F.col("c"))).agg(F.count("*").alias("truth"))
    out = me.pixel_scores(placed, F.col("area") >= tr.MIN_AREA, totals)
    return out.select("quadrant", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("px", "gt", sql=f"WITH {TALL}, {BURNED} SELECT count(*) FILTER (t.r IS NOT NULL AND sc.r IS NOT NULL) AS tp, count(*) FILTER (t.r IS NOT NULL AND sc.r IS NULL AND ig.r IS NULL) AS fp, count(*) FILTER (t.r IS NULL AND sc.r IS NOT NULL) AS fn FROM px LEFT JOIN tall t ON t.r = px.r AND t.c = px.c LEFT JOIN sc ON sc.r = px.r AND sc.c = px.c LEFT JOIN ig ON ig.r = px.r AND ig.c = px.c")
def q_pixel_confusion(px: DataFrame, gt: DataFrame) -> DataFrame:
    height, t = px.agg(F.max("r")).first()[0] + 1, tr.split(gt)
    mark = lambda boxes, name: ca.burned_boxes(boxes, WIDTH, height).withColumn(name, F.lit(1))
    all_ = ra.ndsm(px).join(mark(t.where("keep"), "s"), ["r", "c"], "left").join(mark(t.where("not keep"), "i"), ["r", "c"], "left")
    tall, s, i = F.coalesce(F.col("h") > ra.MIN_HEIGHT, F.lit(False)), F.col("s").isNotNull(), F.col("i").isNotNull()
    return all_.agg(F.count_if(tall & s).alias("tp"), F.count_if(tall & ~s & ~i).alias("fp"), F.count_if(~tall & s).alias("fn"))


SEGS = "sg AS (SELECT CAST(floor(x1 % 100) AS BIGINT) AS c1, CAST(floor(y1 % 150) AS BIGINT) AS r1, CAST(floor(x1 % 100 + 3 * (x2 - x1)) AS BIGINT) AS c2, CAST(floor(y1 % 150 + 3 * (y2 - y1)) AS BIGINT) AS r2 FROM segs), li AS (SELECT DISTINCT CAST(floor(r1 + i * (r2 - r1) / greatest(n, 1) + 0.5) AS INT) AS r, CAST(floor(c1 + i * (c2 - c1) / greatest(n, 1) + 0.5) AS INT) AS c FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM (SELECT *, greatest(abs(c2 - c1), abs(r2 - r1)) AS n FROM sg) z) y)"


def _lines(segs: DataFrame) -> DataFrame:
    x, y = F.col("x1") % 100, F.col("y1") % 150
    return segs.select(x.alias("x1"), y.alias("y1"), (x + 3 * (F.col("x2") - F.col("x1"))).alias("x2"), (y + 3 * (F.col("y2") - F.col("y1"))).alias("y2"))


@query("segs", sql=f"WITH {SEGS} SELECT r, c FROM li")
def q_rasterize_lines(segs: DataFrame) -> DataFrame:
    return ca.burned_lines(_lines(segs))


@query("px", "segs", sql=f"WITH RECURSIVE {LABELS}, {SEGS}, er AS (SELECT x.r, x.c FROM tall x, (VALUES (0,0),(-1,0),(1,0),(0,-1),(0,1)) o(a,b), tall t WHERE t.r = x.r + o.a AND t.c = x.c + o.b GROUP BY x.r, x.c HAVING count(*) = 5) SELECT label, round(count(li.r) / sqrt(count(*)), 6) AS line_ratio FROM lab LEFT JOIN er USING (r, c) LEFT JOIN li ON li.r = er.r AND li.c = er.c AND er.r = lab.r AND er.c = lab.c GROUP BY label")
def q_line_ratio(px: DataFrame, segs: DataFrame) -> DataFrame:
    labels = written(_labels(px), "labels")
    return ca.line_ratio(labels, _lines(segs)).select("label", F.round("line_ratio", 6).alias("line_ratio"))


@query("px", sql=f"WITH RECURSIVE {LABELS}, {RO_W}, {ND}, sm AS (SELECT r, c FROM tall JOIN ro USING (r, c) WHERE rough < 1.25), {labels_sql('sm', 'pat')}, co AS (SELECT label, max(n) AS core FROM (SELECT lab.label, pat.label AS patch, count(*) AS n FROM lab JOIN pat USING (r, c) GROUP BY ALL) z GROUP BY label) SELECT r, c, label FROM lab WHERE label IN (SELECT label FROM lab JOIN h USING (r, c) JOIN nd USING (r, c) LEFT JOIN co USING (label) GROUP BY label HAVING max(h) >= 3.5 AND NOT (avg(ndvi) > 0.5 AND coalesce(any_value(core), 0) < 20 AND count(*) < 400))")
def q_green_filter(px: DataFrame) -> DataFrame:
    return re_.object_filter(written(_labels(px), "labels"), written(_values(px), "values"), most_ndvi=0.5, roof_core=20.0, width=WIDTH).select("r", "c", "label")


@query("px", "segs", sql=f"WITH RECURSIVE {LABELS}, {SEGS} SELECT DISTINCT label FROM lab JOIN li USING (r, c)")
def q_touched_labels(px: DataFrame, segs: DataFrame) -> DataFrame:
    return _labels(px).join(ca.burned_lines(_lines(segs)), ["r", "c"], "left_semi").select("label").distinct()


_FLAGS = {"classifier": "prob >= 0.5", "without bridges": "prob >= 0.5 AND NOT (line_ratio >= 0.8 AND area < 400)", "final": "prob >= 0.5 AND NOT (line_ratio >= 0.8 AND area < 400) AND area >= 30", "fixed rule": "area >= 100", "all candidates": "TRUE"}


@query("cand", sql=" UNION ALL ".join(f"SELECT '{name}' AS method, quadrant, round(CASE WHEN p + t = 0 THEN 0.0 ELSE 2.0 * tp / (p + t) END, 6) AS f1 FROM (SELECT quadrant, coalesce(sum(area) FILTER (({keep}) AND is_building = 1), 0) AS tp, coalesce(sum(area) FILTER ({keep}), 0) AS p, coalesce(sum(area) FILTER (is_building = 1), 0) AS t FROM cand GROUP BY quadrant) z" for name, keep in _FLAGS.items()))
def q_method_comparison(cand: DataFrame) -> DataFrame:
    each = cand.select("quadrant", "area", "is_building", F.explode(F.create_map(*[x for name, keep in _FLAGS.items() for x in (F.lit(name), F.expr(keep))])).alias("method", "keep"))
    part = lambda c: F.sum(F.when(c, F.col("area")).otherwise(0.0))
    true = F.col("is_building") == 1
    k = each.groupBy("method", "quadrant").agg(part(F.col("keep") & true).alias("tp"), part(F.col("keep")).alias("p"), part(true).alias("t"))
    return k.select("method", "quadrant", F.round(me.prf(F.col("tp"), F.col("p"), F.col("t"))[2], 6).alias("f1"))


@query("cand", sql="""WITH g AS (SELECT quadrant, prob, sum(is_building) AS p, sum(1 - is_building) AS n, sum(area * is_building) AS wp, sum(area * (1 - is_building)) AS wn FROM cand GROUP BY ALL),
 k AS (SELECT *, sum(n) OVER u - n AS below, sum(wn) OVER u - wn AS wbelow, sum(p) OVER d AS tp, sum(p + n) OVER d AS nn FROM g WINDOW u AS (PARTITION BY quadrant ORDER BY prob), d AS (PARTITION BY quadrant ORDER BY prob DESC)),
 r AS (SELECT quadrant, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc, round(sum(p * tp / nn) / sum(p), 6) AS ap, round(sum(wp * (wbelow + wn / 2)) / (sum(wp) * sum(wn)), 6) AS auc_weighted FROM k GROUP BY quadrant),
 c AS (SELECT quadrant, count(*) AS candidates, CAST(sum(is_building) AS BIGINT) AS buildings, count(*) FILTER (prob >= 0.5 AND is_building = 1) AS tp, count(*) FILTER (prob >= 0.5 AND is_building = 0) AS fp, count(*) FILTER (prob < 0.5 AND is_building = 1) AS fn, count(*) FILTER (prob < 0.5 AND is_building = 0) AS tn FROM cand GROUP BY quadrant)
 SELECT c.*, auc, ap, auc_weighted, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM c JOIN r USING (quadrant)""")
def q_candidate_report(cand: DataFrame) -> DataFrame:
    kept, true = F.col("prob") >= 0.5, F.col("is_building") == 1
    c = cand.groupBy("quadrant").agg(F.count("*").alias("candidates"), F.sum(F.col("is_building").cast("long")).alias("buildings"), F.count_if(kept & true).alias("tp"), F.count_if(kept & ~true).alias("fp"), F.count_if(~kept & true).alias("fn"), F.count_if(~kept & ~true).alias("tn"))
    out = c.join(me.ranked(cand, "quadrant", "prob", "is_building", "area"), "quadrant")
    share = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select(*c.columns, *[F.round(n, 6).alias(n) for n in ("auc", "ap", "auc_weighted")], share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query("cand", sql="""WITH g AS (SELECT * FROM (VALUES (0.2), (0.4), (0.6), (0.8), (1.0), (99.0)) r(ratio)), k AS (SELECT ratio, quadrant, sum(CASE WHEN prob >= 0.5 AND NOT (line_ratio >= ratio AND area < 5000) AND is_building = 1 THEN area ELSE 0 END) AS tp, sum(CASE WHEN prob >= 0.5 AND NOT (line_ratio >= ratio AND area < 5000) THEN area ELSE 0 END) AS p, sum(CASE WHEN is_building = 1 THEN area ELSE 0 END) AS t FROM cand, g GROUP BY ALL),
 f AS (SELECT ratio, avg(CASE WHEN p + t = 0 THEN 0.0 ELSE 2.0 * tp / (p + t) END) AS f1 FROM k GROUP BY ratio), b AS (SELECT f1 AS base FROM f WHERE ratio = 99)
 SELECT CAST(CASE WHEN max(f1) FILTER (ratio < 99) > any_value(base) + 1e-6 THEN arg_max(ratio, f1 - ratio * 1e-9) FILTER (ratio < 99) END AS DOUBLE) AS ratio, round(greatest(max(f1) FILTER (ratio < 99), any_value(base)), 6) AS f1 FROM f, b""")
def q_greedy_bridge_rule(cand: DataFrame) -> DataFrame:
    ratios = (0.2, 0.4, 0.6, 0.8, 1.0)
    each = cand.withColumn("ratio", F.explode(F.array(*[F.lit(r) for r in (*ratios, 99.0)])))
    kept, true = (F.col("prob") >= 0.5) & ~((F.col("line_ratio") >= F.col("ratio")) & (F.col("area") < 5000)), F.col("is_building") == 1
    part = lambda c: F.sum(F.when(c, F.col("area")).otherwise(0.0))
    k = each.groupBy("ratio", "quadrant").agg(part(kept & true).alias("tp"), part(kept).alias("p"), part(true).alias("t"))
    scores = {r["ratio"]: r["f1"] for r in k.groupBy("ratio").agg(F.avg(me.prf(F.col("tp"), F.col("p"), F.col("t"))[2]).alias("f1")).collect()}
    rule, best = me.greedy_rule([(r, scores[r]) for r in ratios], scores[99.0])
    return cand.sparkSession.createDataFrame([(rule, round(best, 6))], "ratio double, f1 double")


_F1 = "2.0 * sum(CASE WHEN prob >= {t} AND area >= {a} AND is_building = 1 THEN 1 ELSE 0 END) / (sum(CASE WHEN prob >= {t} AND area >= {a} THEN 1 ELSE 0 END) + sum(is_building))"


@query("cand", sql=f"WITH g AS (SELECT t / 10.0 AS t, a FROM range(3, 7) x(t), (VALUES (30), (60)) y(a)), s AS (SELECT t, a, avg(f) AS f FROM (SELECT g.t, g.a, quadrant, {_F1.format(t='g.t', a='g.a')} AS f FROM cand, g WHERE quadrant IN ('sw', 'ne') GROUP BY g.t, g.a, quadrant) z GROUP BY t, a), b AS (SELECT t, a FROM s ORDER BY round(f, 9) DESC, t, a LIMIT 1) SELECT quadrant, round({_F1.format(t='(SELECT t FROM b)', a='(SELECT a FROM b)')}, 6) AS best, round({_F1.format(t='0.5', a='30')}, 6) AS defaults FROM cand WHERE quadrant IN ('se', 'nw') GROUP BY quadrant")
def q_hold_out_check(cand: DataFrame) -> DataFrame:
    grid = F.explode(F.array(*[F.struct(F.lit(t / 10).alias("t"), F.lit(float(a)).alias("a")) for t in range(3, 7) for a in (30, 60)])).alias("g")
    f1 = lambda t, a: F.sum(((F.col("prob") >= t) & (F.col("area") >= a) & (F.col("is_building") == 1)).cast("long")) * 2 / (F.sum(((F.col("prob") >= t) & (F.col("area") >= a)).cast("long")) + F.sum("is_building"))
    tuned = cand.where(F.col("quadrant").isin("sw", "ne")).select("*", grid).groupBy("g", "quadrant").agg(f1(F.col("g.t"), F.col("g.a")).alias("f")).groupBy("g").agg(F.avg("f").alias("f"))
    best = tuned.orderBy(F.round("f", 9).desc(), "g.t", "g.a").first()["g"]
    held = cand.where(F.col("quadrant").isin("se", "nw")).groupBy("quadrant")
    return held.agg(F.round(f1(F.lit(best["t"]), F.lit(best["a"])), 6).alias("best"), F.round(f1(F.lit(0.5), F.lit(30.0)), 6).alias("defaults"))


@query("scenes", sql="SELECT scene, strftime(day, '%Y-%m-%d') AS day, cloud, row_number() OVER (ORDER BY day, scene) AS turn FROM scenes WHERE day BETWEEN DATE '1995-05-15' AND DATE '1995-09-15' AND cloud < 40 AND maxx >= 200 AND minx <= 700 AND maxy >= 100 AND miny <= 900")
def q_scene_search(scenes: DataFrame) -> DataFrame:
    found = ra.search_scenes(scenes, "1995-05-15", "1995-09-15", 40, (200.0, 100.0, 700.0, 900.0))
    return found.select("scene", F.date_format("day", "yyyy-MM-dd").alias("day"), "cloud", "turn")


@query("segs", sql="SELECT count(*) AS lines, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) / 1000, 6) AS km FROM segs WHERE seg_id % 5 <> 0 AND greatest(x1, x2) >= 50 AND least(x1, x2) <= 950 AND greatest(y1, y2) >= 50 AND least(y1, y2) <= 950")
def q_rail_extract(segs: DataFrame) -> DataFrame:
    # every fifth line stands for a tunnel; the box 250..750 is widened by 200
    kept = bx.lines_in(segs.withColumn("tunnel", F.col("seg_id") % 5 == 0).where(~F.col("tunnel")), 250.0, 250.0, 750.0, 750.0, 200.0)
    return kept.agg(F.count("*").alias("lines"), F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))) / 1000, 6).alias("km"))


@query("px", "gt", sql=f"""WITH RECURSIVE {TALL}, {RO_W}, {BURNED}, se AS (SELECT r, c FROM tall JOIN ro USING (r, c) WHERE rough < 1.25), {labels_sql('se', 'l1')}, sz AS (SELECT r, c FROM l1 WHERE label IN (SELECT label FROM l1 GROUP BY label HAVING count(*) >= 10)),
 fi AS (SELECT r, c FROM sz), s AS (SELECT count(t.x) / nullif(count(*), 0) AS tall, count(se.x) / nullif(count(*), 0) AS seeds, count(sz.x) / nullif(count(*), 0) AS sized, count(fi.x) / nullif(count(*), 0) AS final FROM (SELECT sc.r, sc.c FROM sc JOIN px USING (r, c)) b LEFT JOIN (SELECT r, c, 1 AS x FROM tall) t USING (r, c) LEFT JOIN (SELECT r, c, 1 AS x FROM se) se USING (r, c) LEFT JOIN (SELECT r, c, 1 AS x FROM sz) sz USING (r, c) LEFT JOIN (SELECT r, c, 1 AS x FROM fi) fi USING (r, c))
 SELECT round(tall, 6) AS tall, round(seeds, 6) AS seeds, round(sized, 6) AS sized, round(final, 6) AS final, CASE WHEN final >= 0.5 THEN 'detected' WHEN seeds = 0 THEN CASE WHEN tall >= 0.5 THEN 'no smooth roof' ELSE 'not tall enough' END WHEN sized < 0.5 THEN 'seeds too small / size filter' ELSE 'per-footprint filter' END AS verdict FROM s""")
def q_explained(px: DataFrame, gt: DataFrame) -> DataFrame:
    own = written(ra.roughness(ra.ndsm(px)), "px")
    tall = own.where(F.col("h") > ra.MIN_HEIGHT)
    seeds = tall.where(F.col("rough") < ra.MAX_ROUGHNESS)
    sized = written(re_.remove_small(seeds.select("r", "c"), ra.MIN_SEED, WIDTH), "sized")
    building = ca.burned_boxes(tr.split(gt).where("keep"), WIDTH, px.agg(F.max("r")).first()[0] + 1).join(px.select("r", "c"), ["r", "c"], "left_semi")
    out = ca.explained(building, {"tall": tall, "seeds": seeds, "sized": sized, "final": sized})
    return out.select(*[F.round(c, 6).alias(c) for c in ("tall", "seeds", "sized", "final")], "verdict")
