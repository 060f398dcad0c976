"""Polygons across rings, layer checks, tile pyramid: known answers and a brute-force twin."""
import math
import random

import pytest
from pyspark.sql import functions as F

from gridfold.operators import pyramid as Y
from gridfold.operators import quality as Q
from gridfold.operators import validity as V

POINTS = "struct<x:double,y:double>"


def ring(*pts):
    return [(float(x), float(y)) for x, y in (*pts, pts[0])]


def box(x, y, X, Y_):
    return ring((x, y), (X, y), (X, Y_), (x, Y_))


def wheel(n, r):
    return ring(*[(50 + r * math.cos(2 * math.pi * i / n), 50 + r * math.sin(2 * math.pi * i / n)) for i in range(n)])


CASES = [
    ([box(0, 0, 10, 10), box(2, 2, 4, 4)], []),
    ([box(0, 0, 10, 10), box(8, 2, 12, 4)], ["hole_outside", "rings_cross"]),
    ([box(0, 0, 10, 10), box(20, 2, 22, 4)], ["hole_outside"]),
    ([box(0, 0, 10, 10), box(2, 2, 8, 8), box(3, 3, 5, 5)], ["nested_holes"]),
    ([box(0, 0, 10, 10), ring((0, 5), (3, 4), (3, 6))], []),
    ([box(0, 0, 10, 10), box(0, 4, 3, 6)], ["rings_cross"]),
    ([box(0, 0, 10, 10), box(0, 0, 10, 10)], ["rings_cross"]),
    ([ring((0, 0), (10, 10), (10, 0), (0, 10))], ["self_intersection"]),
    ([ring((0, 0), (10, 0), (10, 10), (5, 0.0), (0, 10))], ["self_intersection"]),
    ([box(0, 0, 10, 10), ring((2, 2), (4, 4), (4, 2), (2, 4))], ["self_intersection"]),
    ([[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]], ["not_closed"]),
    ([[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]], ["too_few_points"]),
    ([[(0.0, 0.0), (float("nan"), 0.0), (1.0, 1.0), (0.0, 0.0)]], ["not_finite"]),
    ([], ["empty"]),
    ([wheel(500, 40), wheel(400, 30)], []),
    ([wheel(500, 40), wheel(400, 30), wheel(300, 29)], ["nested_holes"]),
    ([wheel(500, 40), box(15, 45, 25, 55)], []),
    ([wheel(500, 40), box(5, 45, 25, 55)], ["hole_outside", "rings_cross"]),
]


def test_polygon_faults(spark):
    d = spark.createDataFrame([(i, rings) for i, (rings, _) in enumerate(CASES)], f"feature_id long, rings array<array<{POINTS}>>")
    got = {r.feature_id: r.faults for r in V.polygon_faults(d, ["feature_id"]).collect()}
    assert got == {i: faults for i, (_, faults) in enumerate(CASES)}
    assert V.polygon_faults(d.limit(0), ["feature_id"]).count() == 0


def test_small_polygons_in_their_row(spark):
    """In the row or by joined edges the faults are the same, and small polygons are not shuffled."""
    rng = random.Random(4)
    some = [[ring(*[(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(3, 7))]) for _ in range(rng.randrange(1, 4))] for _ in range(400)]
    d = spark.createDataFrame(list(enumerate([*some, *[c for c, _ in CASES]])), f"feature_id long, rings array<array<{POINTS}>>")
    got, other = ({r.feature_id: r.faults for r in V.polygon_faults(d, ["feature_id"], few).collect()} for few in (10_000, 0))
    assert got == other and len(set(map(tuple, got.values()))) > 5
    small = V.polygon_faults(d.where("feature_id < 400"), ["feature_id"])
    assert "Exchange" not in small._jdf.queryExecution().executedPlan().toString()


def test_layer_checks_name_each_fault(spark):
    good = spark.createDataFrame([(1, 1, [box(1, 1, 3, 3)]), (2, 2, [box(1, 1, 3, 3), box(2, 2, 9, 2.5)]), (2, 3, [box(0, 4, .2, 4.2)])], f"site_id int, feature_id long, rings array<array<{POINTS}>>")
    mask = spark.createDataFrame([(1, r, c) for r in (1, 2) for c in (1, 2)] + [(2, 9, 9)], "site_id int, row int, col int")
    nodata = spark.createDataFrame([(2, 1, 2), (2, 2, 2), (1, 7, 7)], "site_id int, row int, col int")
    sites = spark.createDataFrame([(1, 1), (2, 5), (3, 0)], "site_id int, features long").selectExpr("*", "0D xmin", "0D ymin", "8D xmax", "8D ymax")
    got = {(r.site_id, r.check): r.passed for r in V.layer_checks(good, mask, nodata, sites, ["site_id"], 1.0, 1.0).collect()}
    assert all(got[s, c] for s in (1, 3) for c in ("feature_count", "valid", "inside_bounds", "min_area", "interior_points", "round_trip"))
    assert not any(got[2, c] for c in ("feature_count", "valid", "inside_bounds", "min_area", "round_trip"))


@pytest.mark.parametrize("z,res", [(18, 0.43), (19, 1.3), (20, 0.05)])
def test_pyramid_against_brute_force(spark, dice_cells, z, res):
    left, top = -7574321.37, -1865432.11
    cells = spark.createDataFrame([(r, c, v) for (r, c), v in dice_cells.items()], "row int, col int, value double")
    rows = Y.tile_pyramid(cells, [], F.lit(left), F.lit(top), F.lit(res), z, 2).collect()
    ps, e = Y.pixel_size(z), Y.MERCATOR_EDGE
    got = {(r.x * 256 + r.px, r.y * 256 + r.py): r.value for r in rows if r.z == z}
    for (gx, gy), v in got.items():
        u, w = ((gx + .5) * ps - e - left) / res - .5, (top - (e - (gy + .5) * ps)) / res - .5
        total = weight = 0.0
        for r in (math.floor(w), math.floor(w) + 1):
            for c in (math.floor(u), math.floor(u) + 1):
                if (r, c) in dice_cells:
                    k = (1 - abs(r - w)) * (1 - abs(c - u))
                    total, weight = total + k * dice_cells[r, c], weight + k
        assert v == pytest.approx(total / weight, abs=50 * 1.6e-8 / res / weight + 1e-9)  # coordinates near 2e7 m round at 4e-9 m
    up = {}
    for (gx, gy), v in got.items():
        up.setdefault((gx >> 1, gy >> 1), []).append(v)
    assert {k: pytest.approx(sum(v) / len(v)) for k, v in up.items()} == {(r.x * 256 + r.px, r.y * 256 + r.py): r.value for r in rows if r.z == z - 1}
    assert got and all(0 <= r.px < 256 and 0 <= r.py < 256 for r in rows)


@pytest.fixture()
def dice_cells():
    import random
    dice = random.Random(3)
    return {(r, c): dice.random() * 50 for r in range(12) for c in range(12) if dice.random() < 0.8}


def test_elevation_flags(spark):
    d = spark.sql("select 1 bands, named_struct('xmin',0D,'ymin',0D,'xmax',4D,'ymax',4D) m, named_struct('xmin',1D,'ymin',1D,'xmax',4D,'ymax',4D) i, 'a' g, 'a' h union all "
                  "select 2, named_struct('xmin',2D,'ymin',0D,'xmax',4D,'ymax',4D), named_struct('xmin',1D,'ymin',1D,'xmax',4D,'ymax',4D), 'a', cast(null as string) union all select null, null, named_struct('xmin',1D,'ymin',1D,'xmax',4D,'ymax',4D), 'a', 'a'")
    got = [r.f for r in d.select(Q.elevation_flags("dtm", F.col("bands"), F.col("m"), F.col("i"), F.col("g"), F.col("h")).alias("f")).collect()]
    assert got == [["dtm_vertical_units_unverified"], ["dtm_not_single_band", "dtm_does_not_cover_imagery", "dtm_requires_explicit_alignment", "dtm_vertical_units_unverified"], []]
