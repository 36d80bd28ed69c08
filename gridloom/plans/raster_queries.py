"""Raster operators over the fixtures, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import raster as ra
from gridloom.operators import regions as re_
from gridloom.plans.registry import query
from gridloom.plans.scratch import written

WIDTH = 100

H = "h AS (SELECT r, c, dsm, dtm, dsm - dtm AS h FROM px)"
LAP = """l AS (SELECT r, c, abs(lag(dsm, 1, dsm) OVER (PARTITION BY c ORDER BY r) + lead(dsm, 1, dsm) OVER (PARTITION BY c ORDER BY r)
  + lag(dsm, 1, dsm) OVER (PARTITION BY r ORDER BY c) + lead(dsm, 1, dsm) OVER (PARTITION BY r ORDER BY c) - 4 * dsm) AS a FROM px)"""
ROUGH = LAP + """, ro AS (SELECT x.r, x.c, sum(y.a) / count(y.a) AS rough FROM l x JOIN l y ON y.r BETWEEN x.r - 2 AND x.r + 2 AND y.c BETWEEN x.c - 2 AND x.c + 2 GROUP BY x.r, x.c)"""
RO_W = LAP + """, r1 AS (SELECT r, c, sum(a) OVER w AS s, count(a) OVER w AS n FROM l WINDOW w AS (PARTITION BY c ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
 ro AS (SELECT r, c, sum(s) OVER w / nullif(sum(n) OVER w, 0) AS rough FROM r1 WINDOW w AS (PARTITION BY r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""
TALL = H + ", tall AS (SELECT r, c FROM h WHERE h > 2.5)"
_OFF5 = "(VALUES (0,0),(-1,0),(1,0),(0,-1),(0,1)) o(a,b)"
_OFF9 = "(VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) o(a,b)"


def labels_sql(mask: str, out: str) -> str:
    """Connected components as a recursive closure; ``out``(r, c, label)."""
    return f"""{out}_p AS (SELECT CAST(r AS BIGINT) * 100 + c AS p FROM {mask}),
 {out}_e AS (SELECT a.p AS u, b.p AS v FROM {out}_p a JOIN {out}_p b ON (b.p = a.p + 100 OR b.p = a.p - 100 OR (b.p = a.p + 1 AND b.p % 100 <> 0) OR (b.p = a.p - 1 AND a.p % 100 <> 0))),
 {out}_t AS (SELECT p, p AS q FROM {out}_p UNION SELECT t.p, e.v FROM {out}_t t JOIN {out}_e e ON e.u = t.q),
 {out} AS (SELECT CAST(p // 100 AS INT) AS r, CAST(p % 100 AS INT) AS c, min(q) AS label FROM {out}_t GROUP BY p)"""


def _rough(px: DataFrame) -> DataFrame:
    return ra.roughness(ra.ndsm(px))


def _tall(px: DataFrame) -> DataFrame:
    return ra.ndsm(px).where(F.col("h") > ra.MIN_HEIGHT).select("r", "c")


@query("px", sql=f"WITH {H} SELECT r, c, h FROM h")
def q_ndsm(px: DataFrame) -> DataFrame:
    return ra.ndsm(px).select("r", "c", "h")


@query("px", sql=f"""WITH {H} SELECT count(*) AS pixels, round(avg(CASE WHEN h IS NULL THEN 1.0 ELSE 0.0 END), 6) AS nodata, min(h) AS least, max(h) AS most,
  round(avg(CASE WHEN h < -0.5 THEN 1.0 ELSE 0.0 END), 6) AS below, round(avg(CASE WHEN h > 2.5 THEN 1.0 ELSE 0.0 END), 6) AS above, round(quantile_cont(h, 0.99), 6) AS p99 FROM h""")
def q_raster_qa(px: DataFrame) -> DataFrame:
    h = F.col("h")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return ra.ndsm(px).agg(F.count("*").alias("pixels"), share(h.isNull()).alias("nodata"), F.min(h).alias("least"), F.max(h).alias("most"), share(h < -0.5).alias("below"), share(h > 2.5).alias("above"), F.round(F.percentile(h, F.lit(0.99)), 6).alias("p99"))


@query("px", sql=f"WITH {LAP} SELECT r, c, round(a, 6) AS lap FROM l")
def q_laplacian_abs(px: DataFrame) -> DataFrame:
    return ra.laplacian(px).select("r", "c", F.round(F.abs("lap"), 6).alias("lap"))


@query("px", sql=f"WITH {ROUGH} SELECT r, c, round(rough, 6) AS rough FROM ro")
def q_roughness(px: DataFrame) -> DataFrame:
    return ra.roughness(px).select("r", "c", F.round("rough", 6).alias("rough"))


@query("px", sql=f"WITH {RO_W}, {H} SELECT r, c FROM h JOIN ro USING (r, c) WHERE h > 2.5 AND rough < 1.25")
def q_threshold_seeds(px: DataFrame) -> DataFrame:
    return _rough(px).where((F.col("h") > ra.MIN_HEIGHT) & (F.col("rough") < ra.MAX_ROUGHNESS)).select("r", "c")


@query("px", sql=f"""WITH {TALL}, s AS (SELECT r, c FROM tall WHERE (r + c) % 7 = 0), {', '.join(f"g{i} AS (SELECT DISTINCT t.r, t.c FROM {'s' if i == 1 else f'g{i - 1}'} x, {_OFF5}, tall t WHERE t.r = x.r + o.a AND t.c = x.c + o.b)" for i in range(1, 5))} SELECT r, c FROM g4""")
def q_dilate4_masked(px: DataFrame) -> DataFrame:
    tall = _tall(px)
    return ra.grow(tall.where((F.col("r") + F.col("c")) % 7 == 0), tall)


@query("px", sql=f"WITH {TALL} SELECT x.r, x.c FROM tall x, {_OFF5}, tall t WHERE t.r = x.r + o.a AND t.c = x.c + o.b GROUP BY x.r, x.c HAVING count(*) = 5")
def q_erode4(px: DataFrame) -> DataFrame:
    return ra.erode(_tall(px), ra.CROSS)


@query("px", sql=f"""WITH {TALL}, d AS (SELECT DISTINCT p.r, p.c FROM tall t, {_OFF9}, px p WHERE p.r = t.r + o.a AND p.c = t.c + o.b)
 SELECT x.r, x.c FROM d x, {_OFF9}, d y WHERE y.r = x.r + o.a AND y.c = x.c + o.b GROUP BY x.r, x.c HAVING count(*) = 9""")
def q_close3x3(px: DataFrame) -> DataFrame:
    return ra.close3x3(_tall(px), px)


@query("px", sql=f"""WITH {TALL}, e AS (SELECT x.r, x.c FROM tall x, {_OFF5}, tall t WHERE t.r = x.r + o.a AND t.c = x.c + o.b GROUP BY x.r, x.c HAVING count(*) = 5)
 SELECT DISTINCT CAST(e.r + o.a AS INT) AS r, CAST(e.c + o.b AS INT) AS c FROM e, {_OFF5}""")
def q_open_disk(px: DataFrame) -> DataFrame:
    return ra.open_disk(_tall(px), 1)


@query("px", sql="SELECT r, c, dsm FROM px WHERE r >= 20 AND r < 60 AND c >= 10 AND c < 35")
def q_window_scan(px: DataFrame) -> DataFrame:
    return ra.window(px, 20, 60, 10, 35).select("r", "c", "dsm")


@query("px", sql="SELECT CAST(y.r AS INT) AS r, CAST(x.c AS INT) AS c, coalesce(p.dsm, 0.0) AS dsm FROM range(-5, 12) y(r) CROSS JOIN range(90, 110) x(c) LEFT JOIN px p ON p.r = y.r AND p.c = x.c")
def q_boundless_window(px: DataFrame) -> DataFrame:
    return ra.boundless_window(px, "dsm", -5, 12, 90, 110)


@query("px", sql="""WITH s AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM px),
 f AS (SELECT fr.fr, fc.fc, least(greatest((fr.fr + 0.5) / 4 - 0.5, 0), h - 1) AS y, least(greatest((fc.fc + 0.5) / 4 - 0.5, 0), w - 1) AS x FROM s, range(0, 4 * (SELECT h FROM s)) fr(fr), range(0, 4 * (SELECT w FROM s)) fc(fc)),
 q AS (SELECT fr, fc, y, x, CAST(floor(y) + a.a AS INT) AS pr, CAST(floor(x) + b.b AS INT) AS pc FROM f, range(0, 2) a(a), range(0, 2) b(b))
 SELECT CAST(fr AS INT) AS r, CAST(fc AS INT) AS c, round(CASE WHEN count_if(p.dsm IS NULL) = 0 THEN sum(p.dsm * (1 - abs(y - p.r)) * (1 - abs(x - p.c))) END, 6) AS v
 FROM q JOIN px p ON p.r = pr AND p.c = pc WHERE abs(y - p.r) < 1 AND abs(x - p.c) < 1 GROUP BY fr, fc""")
def q_bilinear_upsample(px: DataFrame) -> DataFrame:
    return ra.upsample(px, "dsm", 4).select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.round("dsm", 6).alias("v"))


@query("px", sql="""WITH t AS (SELECT r, c, 1 AS tile, CASE WHEN (r + c) % 3 = 0 THEN NULL ELSE dsm END AS v FROM px WHERE c < 60 UNION ALL SELECT r, c, 2, dsm + 1 FROM px WHERE c >= 40)
 SELECT r, c, arg_min(v, tile) FILTER (v IS NOT NULL) AS v FROM t GROUP BY r, c""")
def q_mosaic_first_valid(px: DataFrame) -> DataFrame:
    one = px.where("c < 60").select("r", "c", F.lit(1).alias("tile"), F.when((F.col("r") + F.col("c")) % 3 != 0, F.col("dsm")).alias("v"))
    two = px.where("c >= 40").select("r", "c", F.lit(2).alias("tile"), (F.col("dsm") + 1).alias("v"))
    return ra.mosaic(one.unionByName(two))


@query("obs", sql="""SELECT r, c, scene, CAST(red_dn - CASE WHEN scene >= 4 THEN 1000 ELSE 0 END AS DOUBLE) / 10000.0 AS red,
 CASE WHEN nir_dn <> 0 THEN CAST(nir_dn - CASE WHEN scene >= 4 THEN 1000 ELSE 0 END AS DOUBLE) / 10000.0 END AS nir FROM obs""")
def q_reflectance_offset(obs: DataFrame) -> DataFrame:
    offset = F.when(F.col("scene") >= 4, 1000).otherwise(0)
    return obs.select("r", "c", "scene", ra.reflectance(F.col("red_dn"), offset).cast("double").alias("red"), ra.reflectance(F.col("nir_dn"), offset).cast("double").alias("nir"))


NDVI = """o AS (SELECT *, CASE WHEN red_dn <> 0 THEN CAST(red_dn - CASE WHEN scene >= 4 THEN 1000 ELSE 0 END AS DOUBLE) / 10000.0 END AS red,
 CASE WHEN nir_dn <> 0 THEN CAST(nir_dn - CASE WHEN scene >= 4 THEN 1000 ELSE 0 END AS DOUBLE) / 10000.0 END AS nir FROM obs),
 n AS (SELECT *, CASE WHEN nir + red <> 0 THEN (nir - red) / (nir + red) END AS ndvi FROM o)"""
CLEAR = (2, 4, 5, 6, 7)


def _ndvi(obs: DataFrame) -> DataFrame:
    offset = F.when(F.col("scene") >= 4, 1000).otherwise(0)
    return obs.withColumn("ndvi", ra.ndvi(ra.reflectance(F.col("nir_dn"), offset), ra.reflectance(F.col("red_dn"), offset)))


@query("obs", sql=f"WITH {NDVI} SELECT r, c, scene, round(ndvi, 6) AS ndvi FROM n")
def q_ndvi_band_math(obs: DataFrame) -> DataFrame:
    return _ndvi(obs).select("r", "c", "scene", F.round("ndvi", 6).alias("ndvi"))


#: The fixture's classes are even, so a scene counts with a clear share of 0.41 here where the reference asks ``ra.MIN_CLEAR``.
LEAST_CLEAR = 0.41
USED = "us AS (SELECT scene FROM obs GROUP BY scene HAVING avg(CASE WHEN scl IN (2, 4, 5, 6, 7) THEN 1.0 ELSE 0.0 END) >= 0.41)"


@query("obs", sql="SELECT scene, round(avg(CASE WHEN scl IN (2, 4, 5, 6, 7) THEN 1.0 ELSE 0.0 END), 6) AS clear FROM obs GROUP BY scene HAVING avg(CASE WHEN scl IN (2, 4, 5, 6, 7) THEN 1.0 ELSE 0.0 END) >= 0.41")
def q_scene_select(obs: DataFrame) -> DataFrame:
    return ra.clear_scenes(obs, CLEAR, LEAST_CLEAR).select("scene", F.round("clear", 6).alias("clear"))


def _composite(obs: DataFrame) -> DataFrame:
    """(r, c, ndvi, clear): the median over clear observations of the scenes that are used."""
    used = obs.join(F.broadcast(ra.clear_scenes(obs, CLEAR, LEAST_CLEAR).select("scene")), "scene", "left_semi")  # one row for each scene
    value = F.when(F.col("scl").isin(*CLEAR), F.col("ndvi"))
    return _ndvi(used).groupBy("r", "c").agg(F.median(value).alias("ndvi"), F.count(value).alias("clear"))


@query("obs", sql=f"WITH {NDVI}, {USED} SELECT r, c, round(median(ndvi) FILTER (scl IN (2, 4, 5, 6, 7)), 6) AS ndvi, count(ndvi) FILTER (scl IN (2, 4, 5, 6, 7)) AS clear FROM n WHERE scene IN (SELECT scene FROM us) GROUP BY r, c")
def q_ndvi_median_composite(obs: DataFrame) -> DataFrame:
    return _composite(obs).select("r", "c", F.round("ndvi", 6).alias("ndvi"), "clear")


@query("obs", sql=f"WITH {NDVI}, {USED}, k AS (SELECT r, c, median(ndvi) AS m, count(ndvi) AS n FROM n WHERE scl IN (2, 4, 5, 6, 7) AND scene IN (SELECT scene FROM us) GROUP BY r, c) SELECT round(quantile_cont(m, 0.05), 6) AS p5, round(quantile_cont(m, 0.5), 6) AS p50, round(quantile_cont(m, 0.95), 6) AS p95, min(n) AS least, median(n) AS middle FROM k")
def q_ndvi_qa(obs: DataFrame) -> DataFrame:
    k = _composite(obs.where(F.col("scl").isNotNull())).join(obs.where(F.col("scl").isin(*CLEAR)).select("r", "c").distinct(), ["r", "c"], "left_semi")
    p = lambda q: F.round(F.percentile("ndvi", F.lit(q)), 6)
    return k.agg(p(0.05).alias("p5"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.min("clear").alias("least"), F.median("clear").alias("middle"))


@query("px", sql=f"WITH RECURSIVE {TALL}, {labels_sql('tall', 'lab')} SELECT r, c, label FROM lab")
def q_components(px: DataFrame) -> DataFrame:
    return re_.components(_tall(px), WIDTH, tile=32)


@query("px", sql=f"WITH RECURSIVE {TALL}, {labels_sql('tall', 'lab')} SELECT r, c FROM lab WHERE label IN (SELECT label FROM lab GROUP BY label HAVING count(*) >= 10)")
def q_remove_small_objects(px: DataFrame) -> DataFrame:
    return re_.remove_small(_tall(px), 10, WIDTH)


@query("px", sql=f"WITH RECURSIVE {TALL}, bg AS (SELECT p.r, p.c FROM px p ANTI JOIN tall t ON t.r = p.r AND t.c = p.c), {labels_sql('bg', 'lab')} SELECT r, c FROM tall UNION ALL SELECT r, c FROM lab WHERE label IN (SELECT label FROM lab GROUP BY label HAVING count(*) <= 10)")
def q_fill_small_holes(px: DataFrame) -> DataFrame:
    return re_.fill_holes(_tall(px), px, 10, WIDTH)


@query("px", sql=f"""WITH RECURSIVE {TALL}, {labels_sql('tall', 'lab')} SELECT label, count(*) AS area, count(h) AS valid, round(sum(h), 6) AS total, round(avg(h), 6) AS mean, min(h) AS least, max(h) AS most,
 round(stddev_pop(h), 6) AS spread, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM lab LEFT JOIN h USING (r, c) GROUP BY label""")
def q_zonal_stats(px: DataFrame) -> DataFrame:
    z = re_.zonal(re_.components(_tall(px), WIDTH), ra.ndsm(px).select("r", "c", F.col("h").alias("v")))
    return z.select("label", "area", "valid", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"), "least", "most", F.round("spread", 6).alias("spread"), "r0", "r1", "c0", "c1")


@query("px", sql=f"WITH RECURSIVE {TALL}, {labels_sql('tall', 'lab')} SELECT label, round(median(h), 6) AS median, round(quantile_cont(h, 0.95), 6) AS p95, max(h) AS most FROM lab JOIN h USING (r, c) GROUP BY label")
def q_zonal_percentiles(px: DataFrame) -> DataFrame:
    z = re_.zonal(re_.components(_tall(px), WIDTH), ra.ndsm(px).select("r", "c", F.col("h").alias("v")))
    return z.select("label", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "most")


@query("px", sql=f"""WITH RECURSIVE {TALL}, {RO_W}, {labels_sql('tall', 'lab')} SELECT r, c, label FROM lab WHERE label IN (SELECT label FROM lab JOIN h USING (r, c) JOIN ro USING (r, c) GROUP BY label
 HAVING max(h) >= 3.5 AND avg(rough) <= 3 AND avg(CASE WHEN rough < 1.25 THEN 1.0 ELSE 0.0 END) >= 0.1)""")
def q_object_filter(px: DataFrame) -> DataFrame:
    full = written(_rough(px), "px")
    return re_.object_filter(re_.components(_tall(px), WIDTH), full, most_rough=3.0, least_smooth=0.1).select("r", "c", "label")


@query("px", sql=f"""WITH RECURSIVE {TALL}, {RO_W}, {labels_sql('tall', 'lab')}, sm AS (SELECT r, c FROM tall JOIN ro USING (r, c) WHERE rough < 1.25), {labels_sql('sm', 'pat')},
 k AS (SELECT lab.label, pat.label AS patch, count(*) AS n FROM lab JOIN pat USING (r, c) GROUP BY ALL)
 SELECT l.label, coalesce(max(k.n), 0) AS patch FROM (SELECT DISTINCT label FROM lab) l LEFT JOIN k ON k.label = l.label GROUP BY l.label""")
def q_largest_smooth_patch(px: DataFrame) -> DataFrame:
    labels = written(re_.components(_tall(px), WIDTH), "labels")
    return re_.largest_smooth_patch(labels, _rough(px), WIDTH)


@query("px", sql=f"""WITH RECURSIVE {TALL}, {RO_W}, sd AS (SELECT r, c FROM tall JOIN ro USING (r, c) WHERE rough < 1.25), {labels_sql('sd', 'l1')},
 g0 AS (SELECT r, c FROM l1 WHERE label IN (SELECT label FROM l1 GROUP BY label HAVING count(*) >= 10)), {', '.join(f"g{i} AS (SELECT DISTINCT t.r, t.c FROM g{i - 1} x, {_OFF5}, tall t WHERE t.r = x.r + o.a AND t.c = x.c + o.b)" for i in range(1, 5))},
 d AS (SELECT DISTINCT p.r, p.c FROM g4 t, {_OFF9}, px p WHERE p.r = t.r + o.a AND p.c = t.c + o.b),
 cl AS (SELECT x.r, x.c FROM d x, {_OFF9}, d y WHERE y.r = x.r + o.a AND y.c = x.c + o.b GROUP BY x.r, x.c HAVING count(*) = 9),
 bg AS (SELECT p.r, p.c FROM px p ANTI JOIN cl t ON t.r = p.r AND t.c = p.c), {labels_sql('bg', 'l2')},
 fi AS (SELECT r, c FROM cl UNION ALL SELECT r, c FROM l2 WHERE label IN (SELECT label FROM l2 GROUP BY label HAVING count(*) <= 10)), {labels_sql('fi', 'l3')}
 SELECT r, c, label FROM l3 WHERE label IN (SELECT label FROM l3 JOIN h USING (r, c) GROUP BY label HAVING count(*) >= 20 AND max(h) >= 3.5)""")
def q_extract_mask(px: DataFrame) -> DataFrame:
    return re_.extract_mask(_rough(px), WIDTH).select("r", "c", "label")


@query("px", sql=f"""WITH RECURSIVE {TALL}, {labels_sql('tall', 'lab')}, m AS (SELECT label, count(*) AS n, avg(r) AS mr, avg(c) AS mc, var_pop(r) + 1.0 / 12 AS vr, var_pop(c) + 1.0 / 12 AS vc, covar_pop(r, c) AS vx FROM lab GROUP BY label),
 e AS (SELECT *, sqrt((vr - vc) * (vr - vc) / 4 + vx * vx) AS d FROM m)
 SELECT label, n AS area, round(mr, 6) AS r, round(mc, 6) AS c, round(4 * sqrt((vr + vc) / 2 + d), 6) AS major, round(4 * sqrt(greatest((vr + vc) / 2 - d, 0)), 6) AS minor FROM e""")
def q_region_moments(px: DataFrame) -> DataFrame:
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    m = re_.components(_tall(px), WIDTH).groupBy("label").agg(F.count("*").alias("area"), F.avg(r).alias("mr"), F.avg(c).alias("mc"), (F.var_pop(r) + 1.0 / 12).alias("vr"), (F.var_pop(c) + 1.0 / 12).alias("vc"), F.covar_pop(r, c).alias("vx"))
    half, d = (F.col("vr") + F.col("vc")) / 2, F.sqrt((F.col("vr") - F.col("vc")) * (F.col("vr") - F.col("vc")) / 4 + F.col("vx") * F.col("vx"))
    return m.select("label", "area", F.round("mr", 6).alias("r"), F.round("mc", 6).alias("c"), F.round(4 * F.sqrt(half + d), 6).alias("major"), F.round(4 * F.sqrt(F.greatest(half - d, F.lit(0.0))), 6).alias("minor"))
