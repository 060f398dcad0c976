"""Known answers for measures, coverage, pairs and topology."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfold.functions import measures as M
from gridfold.functions import projection as G
from gridfold.operators import pairs as P
from gridfold.operators import spans as S
from gridfold.operators import topology as O

SCHEMA = "site_id int, feature_type string, feature_id long, rings array<array<struct<x:double,y:double>>>"


def ring(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in [*pts, pts[0]]]


def box(x0, y0, x1, y1):
    return [ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def frame(spark, shapes, kind="b"):
    return spark.createDataFrame([(0, kind, i, r) for i, r in enumerate(shapes)], SCHEMA)


def test_area_with_hole_and_far_origin(spark):
    far = 8_171_000.0
    hole = [ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((2, 2), (4, 2), (4, 4), (2, 4))]
    moved = [[{"x": p["x"] + 600_000, "y": p["y"] + far} for p in r] for r in hole]
    d = frame(spark, [hole, moved]).withColumn("rings", M.orient_rings(F.col("rings")))
    rows = d.select(M.area(F.col("rings")).alias("a"), M.perimeter(F.col("rings")).alias("p"), M.centroid(F.col("rings")).alias("c")).collect()
    assert [round(r.a, 6) for r in rows] == [96, 96]
    assert rows[0].p == 48
    cx = (100 * 5 - 4 * 3) / 96
    assert rows[0].c.x == pytest.approx(cx) and rows[1].c.x == pytest.approx(600_000 + cx)


def test_coverage_matches_cell_centre_test(spark):
    rng = np.random.default_rng(3)
    shapes = []
    for _ in range(6):
        ang = np.sort(rng.uniform(0, 2 * math.pi, 9))
        rad = rng.uniform(2, 8, 9)
        shapes.append([ring(*[(10 + r * math.cos(a), 9 + r * math.sin(a)) for a, r in zip(ang, rad)])])
    d = S.coverage(frame(spark, shapes), 0.5)
    got = {i: set() for i in range(6)}
    for r in S.to_cells(S.explode_spans(d, "feature_id")).collect():
        got[r.feature_id].add((r.row, r.col))
    edges = {i: set() for i in range(6)}
    for r in S.to_cells(S.coverage_by_edges(frame(spark, shapes), ["feature_id"], 0.5)).collect():
        edges[r.feature_id].add((r.row, r.col))
    for i, (pts,) in enumerate(shapes):
        want = set()
        for row in range(0, 40):
            for col in range(0, 44):
                x, y, inside = (col + .5) * .5, (row + .5) * .5, False
                for a, b in zip(pts, pts[1:]):
                    if (a["y"] <= y) != (b["y"] <= y) and x < a["x"] + (y - a["y"]) / (b["y"] - a["y"]) * (b["x"] - a["x"]):
                        inside = not inside
                if inside:
                    want.add((row, col))
        assert got[i] == want and edges[i] == want


def test_overlay_counts_against_sets(spark):
    rng = np.random.default_rng(1)
    rows = [(0, int(r), int(c), int(c + w)) for r, c, w in zip(rng.integers(0, 4, 60), rng.integers(-40, 200, 60), rng.integers(1, 90, 60))]
    a = spark.createDataFrame(rows[:30], "k int, row int, c0 int, c1 int")
    b = spark.createDataFrame(rows[30:], "k int, row int, c0 int, c1 int")
    got = {}
    for r in S.overlay({"a": a, "b": b}, ["k"]).collect():
        for c in range(r.c0, r.c1):
            assert (r.row, c) not in got
            got[r.row, c] = (r.a, r.b)
    want = {}
    for side, part in ((0, rows[:30]), (1, rows[30:])):
        for _, r, c0, c1 in part:
            for c in range(c0, c1):
                v = list(want.get((r, c), (0, 0)))
                v[side] += 1
                want[r, c] = tuple(v)
    assert got == want


@pytest.mark.parametrize("shift,relation", [(8, "overlap"), (3, "overlap"), (40, None), (10, "shared_boundary"), (0.1, "duplicate"), (10.2, "shared_boundary")])
def test_pair_relation_of_ten_metre_squares(spark, shift, relation):
    d = frame(spark, [box(0, 0, 10, 10), box(shift, 0, 10 + shift, 10)])
    rows = O.pair_relations(d, 0.1).collect()
    assert [r.relation for r in rows] == ([relation] if relation else [])
    if shift == 8:
        assert round(rows[0].overlap_m2, 6) == 20 and rows[0].severity == "warning"
    if shift == 3:
        assert rows[0].severity == "error"
    if shift == 10:
        assert 10 <= rows[0].length_m <= 11.5


def test_copies_are_counted_not_multiplied(spark):
    d = frame(spark, [box(0, 0, 2, 2)] * 5 + [box(1, 0, 3, 2)])
    rows = {(r.a, r.b): r for r in O.pair_relations(d, 0.1).collect()}
    assert rows[0, 0].pairs == 10 and rows[0, 0].relation == "duplicate"
    assert rows[0, 5].pairs == 5 and rows[0, 5].relation == "overlap"
    listed = P.expand_pairs(O.pair_relations(d, 0.1), d, ["site_id", "feature_type"]).collect()
    assert len({(r.feature_a, r.feature_b) for r in listed}) == 15


def test_narrow_gap_is_reported(spark):
    d = S.coverage(frame(spark, [box(0, 0, 10, 10), box(10.3, 0, 20, 10)]), 0.1).withColumnRenamed("feature_id", "id")
    rows = O.gap_conflicts(d, 0.1).collect()
    assert len(rows) == 1 and rows[0].features == 2
    wide = S.coverage(frame(spark, [box(0, 0, 10, 10), box(11, 0, 20, 10)]), 0.1).withColumnRenamed("feature_id", "id")
    assert O.gap_conflicts(wide, 0.1).count() == 0


def test_bow_tie_is_invalid(spark):
    bow = [ring((0, 0), (10, 10), (10, 0), (0, 10))]
    d = frame(spark, [bow, box(0, 0, 1, 1)])
    got = [r.f for r in d.orderBy("feature_id").select(O.ring_faults(F.col("rings")).alias("f")).collect()]
    assert got == [["self_intersection"], []]
    assert [r.feature_id for r in O.crossing_rings(d, ["feature_id"]).collect()] == [0]


def test_shared_edge_at_vertex(spark):
    d = frame(spark, [box(0, 0, 10, 10), box(10, 0, 20, 10)])
    v = spark.createDataFrame([(0, "b", 0, 10.0, 5.0), (0, "b", 0, 0.0, 5.0)], "site_id int, feature_type string, target long, x double, y double")
    rows = O.shared_edge_at_vertex(d, v, 0.1).collect()
    assert [(r.x, r.neighbour) for r in rows] == [(10.0, 1)]


def test_nearest_line_against_brute_force(spark):
    rng = np.random.default_rng(5)
    shapes = [box(x, y, x + 2, y + 1) for x, y in rng.uniform(0, 300, (25, 2))]
    d = frame(spark, shapes).withColumn("segs", M.segments(F.col("rings")))
    lines = spark.createDataFrame([(0, 10.0, 10.0, 20.0, 12.0), (0, 250.0, 0.0, 250.0, 100.0)], "site_id int, x1 double, y1 double, x2 double, y2 double")
    got = {r.feature_id: r.distance for r in P.nearest_line(d, lines, ["site_id"], "feature_id", 5.0).collect()}
    t = np.linspace(0, 1, 4001)
    pts = np.vstack([np.c_[10 + 10 * t, 10 + 2 * t], np.c_[250 + 0 * t, 100 * t]])
    for i, (r,) in enumerate(shapes):
        x0, y0, x1, y1 = r[0]["x"], r[0]["y"], r[2]["x"], r[2]["y"]
        dx = np.maximum(0, np.maximum(x0 - pts[:, 0], pts[:, 0] - x1))
        dy = np.maximum(0, np.maximum(y0 - pts[:, 1], pts[:, 1] - y1))
        assert got[i] == pytest.approx(float(np.hypot(dx, dy).min()), abs=0.02)


def test_projection_of_published_points(spark):
    # Published longitude, latitude and UTM 19S coordinates.
    pts = [(-68.0546701, -16.5374394, 600871.41, 8171377.7), (-68.0547321, -16.5374139, 600864.81, 8171380.55)]
    d = spark.createDataFrame(pts, "lon double, lat double, x double, y double")
    r = d.select("x", "y", G.to_utm(F.col("lon"), F.col("lat"), 19, True).alias("p")).collect()
    assert all(abs(v.p.x - v.x) < 0.02 and abs(v.p.y - v.y) < 0.02 for v in r)
