"""Known answers of the geometry kernels, the booster and the brute-force forms of raster steps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import kernels as ke
from gridloom.functions import projection as pj
from gridloom.functions import rings as rg
from gridloom.operators import boosting, boxes, regions
from gridloom.operators import evaluation as ev
from gridloom.operators import metrics as me
from gridloom.operators import raster as ra
from gridloom.plans.vector_queries import q_rasterize_boxes

SQUARE = ke.closed(np.array([[0, 0], [1, 0], [1, 1], [0, 1.0]]))
CORNER = ke.closed(np.array([[0, 0], [4, 0], [4, 2], [2, 2], [2, 4], [0, 4.0]]))


def turned(points, degrees):
    t = math.radians(degrees)
    return points @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])


def test_areas_and_shapes():
    assert ke.area(SQUARE) == 1
    assert abs(ke.area(CORNER)) == 12
    assert ke.rectangularity(CORNER) == pytest.approx(12 / 16)
    assert ke.turning_share(CORNER) == 1


def test_rotated_rectangle():
    r = turned(ke.closed(np.array([[0, 0], [4, 0], [4, 2], [0, 2.0]])), 30)
    assert ke.area(r) == pytest.approx(8)
    assert math.degrees(ke.dominant_angle(r)) == pytest.approx(30)
    (out,), source = ke.regularise([r])
    assert source == "own" and ke.iou([out], [r]) == pytest.approx(1)


def test_notch_is_squared_away():
    notched = ke.closed(np.array([[0, 0], [10, 0], [10, 6], [5.3, 6], [5.3, 5.7], [5, 5.7], [5, 6], [0, 6.0]]))
    (out,), source = ke.regularise([notched])
    assert len(out) == 5 and source == "own" and ke.iou([out], [notched]) > 0.95


def test_overlay_and_holes():
    a, b = ke.closed(np.array([[0, 0], [4, 0], [4, 4], [0, 4.0]])), ke.closed(np.array([[3, 0], [7, 0], [7, 4], [3, 4.0]]))
    assert ke.overlay_areas([a], [b]) == pytest.approx((16, 16, 4))
    shell, hole = a * 2.5, ke.closed(np.array([[4, 4], [6, 4], [6, 6], [4, 6.0]]))
    assert ke.overlay_areas([shell, hole], [shell, hole]) == pytest.approx((96, 96, 96))
    x, y = ke.point_on_surface([shell, hole])
    assert ke.contains(shell, np.array([[x, y]]))[0] and not ke.contains(hole, np.array([[x, y]]))[0]


def test_simplify_and_trace():
    stairs = np.array([[i * 0.4, (i // 2) * 0.8] for i in range(12)])
    assert len(ke.simplify(stairs, 0.75)) == 2
    mask = np.ones((4, 4), dtype=bool)
    mask[1, 1] = False
    assert [abs(ke.area(r)) for r in ke.trace(mask)] == [16, 1]


def test_ring_columns(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in CORNER])
    row = spark.range(1).select(rg.ring_area(ring).alias("a"), rg.ring_length(ring).alias("n"), rg.dominant_angle(ring).alias("d")).first()
    assert (row["a"], row["n"]) == (12, 16) and row["d"] == pytest.approx(0)


def grid(spark, mask):
    return spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(mask)], "r int, c int")


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_components_do_not_depend_on_tiles(spark, tile):
    mask = np.random.default_rng(3).random((30, 30)) < 0.55
    got = {(r, c): label for r, c, label in regions.components(grid(spark, mask), 30, tile).collect()}
    seen: dict = {}
    for r, c in np.argwhere(mask).tolist():
        if (r, c) in seen:
            continue
        stack, seen[r, c] = [(r, c)], r * 30 + c
        while stack:
            y, x = stack.pop()
            for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= p[0] < 30 and 0 <= p[1] < 30 and mask[p] and p not in seen:
                    seen[p] = r * 30 + c
                    stack.append(p)
    assert got == seen


def test_closing_clears_the_outer_ring(spark):
    mask = np.ones((6, 6), dtype=bool)
    got = ra.close3x3(grid(spark, mask), grid(spark, mask)).collect()
    assert {(r, c) for r, c in got} == {(r, c) for r in range(1, 5) for c in range(1, 5)}


def test_empty_mask(spark):
    empty = spark.createDataFrame([], "r int, c int")
    assert regions.components(empty, 10).count() == 0
    assert ra.dilate(empty, ra.CROSS).count() == 0


def test_nearest_of_one_point_is_null(spark):
    one = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert boxes.nearest_other(one).collect()[0]["nearest"] is None


def test_every_box_is_rasterised(spark):
    rows = [(0, 0.0, 0.0, 2.0, 1.0), (199, 3.6, 1.0, 5.4, 2.6), (200, 0.4, 7.0, 1.6, 8.0), (5000, 9.0, 9.0, 10.0, 11.0), (5001, 2.6, 3.0, 3.4, 5.0)]
    got = q_rasterize_boxes(spark.createDataFrame(rows, "fid long, minx double, miny double, maxx double, maxy double")).collect()
    inside = [(f, c, r) for f, x0, y0, x1, y1 in rows for c in range(12) for r in range(12) if x0 <= c + 0.5 < x1 and y0 <= r + 0.5 < y1]
    assert sorted((r["fid"], r["c"], r["r"]) for r in got) == inside


def test_booster_has_the_size_of_the_reference():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 2))
    model = boosting.Booster().fit(x, (x.sum(axis=1) + rng.normal(size=3000) > 0).astype(float), np.ones(3000))
    leaves = [sum(len(node) == 1 for node in tree) for tree in model.trees]
    assert len(model.trees) == 300 and max(leaves) == 31
    assert all(len(edges) + 1 == 255 for edges in model.edges)
    assert (model.settings.rate, model.settings.penalty, model.settings.least) == (0.05, 1.0, 20)


def test_booster_learns_with_missing_values():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    x[rng.random(800) < 0.1, 2] = np.nan
    model = boosting.Booster().fit(x[:600], y[:600], np.ones(600))
    assert np.mean((model.probability(x[600:]) > 0.5) == y[600:]) > 0.9


def test_a_step_is_kept():
    """A side that steps by three units keeps its step, at right angles."""
    ring = np.array([(0, 0), (10, 0), (14, 3), (20, 3), (20, 10), (0, 10), (0, 0)], dtype=float)
    out = ke.square_ring(ring, 0.0)
    assert {(20.0, 3.0), (20.0, 10.0), (0.0, 10.0), (0.0, 0.0), (10.0, 0.0)} <= {(round(x, 6), round(y, 6)) for x, y in out}
    assert ke.turning_share(out) == 1 and abs(ke.area(out)) == pytest.approx(20 * 10 - 4 * 1.5 - 6 * 3)


def test_small_steps_merge_by_length():
    ring = np.array([(0, 0), (6, 0), (8, 0.6), (8, 5), (0, 5), (0, 0)], dtype=float)
    out = ke.square_ring(ring, 0.0)
    second = math.hypot(2, 0.6)
    assert sorted({round(y, 6) for _, y in out}) == [round(0.3 * second / (6 + second), 6), 5.0] and len(out) == 5


def test_runaway_corner_keeps_its_vertex():
    """Edges at 45 degrees have no axis; a corner that would move too far stays where it was."""
    ring = np.array([(0, 0), (10, 0), (10.3, 0.3), (10.6, 8), (0, 8), (0, 0)], dtype=float)
    out = ke.square_ring(ring, 0.0)
    assert np.abs(out).max() < 12
    assert ke.crossing(np.zeros(2), np.array([1.0, 0.0]), np.ones(2), np.array([math.cos(0.08), math.sin(0.08)])) is None
    assert ke.crossing(np.zeros(2), np.array([1.0, 0.0]), np.ones(2), np.array([0.0, 1.0])).tolist() == [1.0, 0.0]


def test_run_start():
    assert ke.run_start(np.array([0, 0, 1, 1, 0])) == 2 and ke.run_start(np.array([0, 1, -1])) == 0 and ke.run_start(np.array([1, 1])) == 0


def test_contour_of_a_block():
    """Half a unit less than w * h; a hole gives half a unit back."""
    assert abs(ke.area(ke.contour(np.ones((4, 7), dtype=bool))[0])) == 27.5
    ringed = np.ones((5, 5), dtype=bool)
    ringed[2, 2] = False
    shell, hole = ke.contour(ringed)
    assert ke.area(shell) * ke.area(hole) < 0 and abs(ke.area(shell) + ke.area(hole)) == 24
    block = np.ones((20, 30), dtype=bool)
    block[6:12, 8:18] = False
    (out, inner), source = ke.regularise(ke.contour(block))
    assert source == "own" and abs(ke.area(out)) == pytest.approx(600, rel=0.05) and abs(ke.area(inner)) == pytest.approx(60, rel=0.2) and ke.area(inner) * ke.area(out) < 0


def test_road_direction():
    ring = np.array([(0, 0), (12, 1.5), (11.5, 6.5), (-0.5, 5), (0, 0)], dtype=float)
    road = math.radians(10)
    assert ke.regularise([ring], road)[1] == "road" and ke.regularise([ring], road + math.radians(30))[1] == "own"
    assert ke.segment_gap(ring, np.array([(0.0, -3.0), (12.0, -3.0)])) == pytest.approx(3.0)
    assert ke.segment_gap(ring, np.array([(5.0, -3.0), (5.0, 20.0)])) == 0


def test_grid_to_longitude_and_latitude(spark):
    """The published worked example of the projection, and a round trip through both datums."""
    x, y = F.lit(651409.903), F.lit(313177.270)
    row = spark.range(1).select(pj.grid_to_airy(x, y).alias("a"), pj.to_lonlat(x, y).alias("g")).select(F.degrees("a.x").alias("lon"), F.degrees("a.y").alias("lat"), pj.to_grid(F.col("g.x"), F.col("g.y")).alias("b")).select("lon", "lat", "b.*").first()
    assert row["lat"] == pytest.approx(52 + 39 / 60 + 27.2531 / 3600, abs=1e-7) and row["lon"] == pytest.approx(1 + 43 / 60 + 4.5177 / 3600, abs=1e-7)
    assert row["x"] == pytest.approx(651409.903, abs=0.05) and row["y"] == pytest.approx(313177.270, abs=0.05)


def test_pixel_and_map(spark):
    row, column = ra.pixel_at(F.lit(290012.5), F.lit(99980.2), 290000.0, 100000.0, 1.0)
    got = spark.range(1).select(row.alias("r"), column.alias("c")).select("r", "c", ra.map_x(F.col("c"), 290000.0, 1.0).alias("x"), ra.map_y(F.col("r"), 100000.0, 1.0).alias("y")).first()
    assert tuple(got) == (19, 12, 290012.5, 99980.5)


def test_greedy_rule():
    assert me.greedy_rule([(0.2, 0.5), (0.4, 0.7), (0.6, 0.7 + 5e-7)], 0.6) == (0.4, 0.7) and me.greedy_rule([(0.2, 0.5)], 0.6) == (None, 0.6)


def test_groups_are_dealt_to_the_emptiest_fold(spark):
    """Groups of unequal size: a plain deal in turn would give other folds."""
    sizes = [9, 7, 6, 5, 4, 3, 1]
    df = spark.createDataFrame([(g, i) for g, n in enumerate(sizes) for i in range(n)], "g int, i int")
    folds = {r["g"]: r["fold"] for r in me.group_folds(df, "g", 3).collect()}
    assert folds == {0: 0, 1: 1, 2: 2, 3: 2, 4: 1, 5: 0, 6: 1}


def test_draws_repeat_tiles(spark):
    rows = ev.draws(spark, 20, 25).groupBy("rep").agg(F.countDistinct("place").alias("n")).collect()
    assert all(r["n"] < 25 for r in rows)
