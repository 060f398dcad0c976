"""Hulls and smallest rectangles against plain search."""
import math
import random

import pytest

from gridfold.operators import hulls as H


def test_hull_and_rectangle_of_random_points():
    dice = random.Random(2)
    for _ in range(300):
        points = [(dice.randrange(12), dice.randrange(12)) for _ in range(dice.randrange(3, 25))]
        hull = H.convex_hull(points)
        if len(hull) < 3:
            continue
        for p, q in zip(hull, hull[1:] + hull[:1]):
            assert all((q[0] - p[0]) * (o[1] - p[1]) - (q[1] - p[1]) * (o[0] - p[0]) >= 0 for o in points)
        long, short = H.smallest_rectangle(hull)
        best = min((max(a) - min(a)) * (max(b) - min(b)) for t in range(1800) for a, b in [zip(*[(x * math.cos(t * math.pi / 1800) + y * math.sin(t * math.pi / 1800), y * math.cos(t * math.pi / 1800) - x * math.sin(t * math.pi / 1800)) for x, y in points])])
        assert long * short <= best + 1e-9 and long * short >= best * 0.9 and long >= short


@pytest.mark.parametrize("band", [1024, 4])
def test_sloping_strip_is_as_long_as_it_is(spark, monkeypatch, band):
    monkeypatch.setattr(H, "BAND", band)
    strip = [(0, r, r) for r in range(9)] + [(0, r, r + 1) for r in range(8)]  # a staircase at 45 degrees
    flat = [(1, 5, c) for c in range(12)]
    got = {r.k: (r.long_side, r.short_side) for r in H.region_sides(spark.createDataFrame(strip + flat, "k int, row int, col int"), ["k"]).collect()}
    assert got[1] == (12.0, 1.0)
    assert got[0][0] == pytest.approx(9 * math.sqrt(2)) and got[0][1] == pytest.approx(3 / math.sqrt(2))  # the box's longer side is 9
