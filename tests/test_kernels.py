"""Array kernels against plain loops, in one chunk and in many, and on empty and missing arrays."""
import math
import random

import pytest
from pyspark.sql import functions as F

from gridfold.functions import kernels as N
from gridfold.operators import scoring as C

SEGS = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def outline(rng, grid):
    n = rng.randint(3, 9)
    pts = [(rng.randint(0, 30) / 10, rng.randint(-9, 30) / 10) if grid else (rng.uniform(0, 3), rng.uniform(-1, 3)) for _ in range(n)]
    return [(*p, *q) for p, q in zip(pts, pts[1:] + pts[:1])]


def cell(v):
    return math.ceil(v / 0.1 - 0.5)


def spans(segs):
    out, ys = [], [y for s in segs for y in (s[1], s[3])]
    for r in range(cell(min(ys)), cell(max(ys))) if segs else ():
        yc = (r + 0.5) * 0.1
        xs = sorted(cell(a + (yc - b) / (d - b) * (c - a)) for a, b, c, d in segs if (b <= yc) != (d <= yc))
        out += [(r, a, b) for a, b in zip(xs[::2], xs[1::2]) if b > a]
    return out


def far(p, s):
    (px, py), (a, b, c, d) = p, s
    dx, dy = c - a, d - b
    t = min(1, max(0, ((px - a) * dx + (py - b) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
    return math.hypot(px - a - t * dx, py - b - t * dy)


def samples(segs):
    for a, b, c, d in segs:
        if (a, b) != (c, d):
            n = max(1, math.ceil(math.hypot(c - a, d - b) / 0.1 - 1e-6))
            yield from (((a + (c - a) * (i + .5) / n, b + (d - b) * (i + .5) / n), math.hypot(c - a, d - b) / n) for i in range(n))


@pytest.mark.parametrize("chunk", [7, 2_000_000])
def test_outlines(spark, monkeypatch, chunk):
    rng = random.Random(5)
    rows = [(i, outline(rng, i % 2 == 0), outline(rng, i % 3 == 0)) for i in range(60)] + [(90, [], outline(rng, True)), (91, outline(rng, True), []), (92, None, [])]
    if chunk == 7:  # in this process: the kernels' own chunks
        import pyarrow as pa
        monkeypatch.setattr(N, "CHUNK", chunk)
        one = pa.array([[dict(zip(N.EDGE, s)) for s in a or ()] for _, a, _ in rows]), pa.array([[dict(zip(N.EDGE, s)) for s in b] for _, _, b in rows])
        near, whole = N._covered(*one, 0.1, 0.3)
        for (_, a, b), n, w in zip(rows, near, whole):
            assert n == pytest.approx(sum(w for p, w in samples(a or ()) if any(far(p, s) <= 0.3 for s in b))) and w == pytest.approx(sum(w for _, w in samples(a or ())))
        return
    d = spark.createDataFrame(rows, f"i int, a {SEGS}, b {SEGS}").repartition(3)
    d = d.select("i", "a", "b", N.span_array(F.col("a"), 0.1).alias("sa"), N.span_array(F.col("b"), 0.1).alias("sb"))
    d = d.select("*", N.shared_cells(F.col("sa"), F.col("sb")).alias("inter"), N.gap_sq(F.col("sa"), F.col("sb")).alias("gap"),
                 N.covered_length(F.col("a"), F.col("b"), 0.1, 0.3).alias("near"), N.point_distance(F.lit(1.0), F.lit(-2.0), F.col("b")).alias("dist"), N.farthest_sq(F.col("a"), F.col("b")).alias("far"))
    got = {r.i: r for r in d.collect()}
    assert len(got) == len(rows)
    for i, a, b in rows:
        r, a = got[i], a or []
        p, q = spans(a), spans(b)
        assert [tuple(s) for s in r.sa] == p and [tuple(s) for s in r.sb] == q
        cells = [{(row, c) for row, lo, hi in s for c in range(lo, hi)} for s in (p, q)]
        gaps = [max(0, s[1] - t[2], t[1] - s[2]) ** 2 + max(0, abs(s[0] - t[0]) - 1) ** 2 for s in p for t in q]
        assert r.gap == (min(gaps) if gaps else None)
        assert r.inter == sum(max(0, min(s[2], t[2]) - max(s[1], t[1])) for s in p for t in q if s[0] == t[0]) and r.inter >= len(cells[0] & cells[1])
        assert r.near == pytest.approx(sum(w for p, w in samples(a) if any(far(p, s) <= 0.3 for s in b)))
        assert (r.dist is None) == (not b) and (not b or r.dist == pytest.approx(min(far((1, -2), s) for s in b)))
        ends = [(s[k], s[k + 1]) for s in a for k in (0, 2)]
        assert (r.far is None) if not a or not b else math.sqrt(r.far) == pytest.approx(max(min(far(e, s) for s in b) for e in ends))


def test_work_is_not_left_to_lambdas(spark):
    d = spark.createDataFrame([([(0.0, 0.0, 1.0, 0.0)], [(0.0, 0.2, 1.0, 0.2)])], f"ref {SEGS}, pred {SEGS}")
    plan = C.boundary_scores(d, 0.3, 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambdafunction" not in plan


def test_strips_and_lines(spark):
    rng = random.Random(8)
    rows = []
    for i in range(40):
        a, b = ([(r, c, c + rng.randint(1, 4)) for r, c in ((rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(1, 4)))] for _ in "ab")
        rows.append((i, a, b, rng.choice([1.5, 2.0, 3.0]), bool(i % 2), outline(rng, True), *(rng.randint(-9, 39) / 10 for _ in range(4))))
    d = spark.createDataFrame(rows, f"i int, a {N.SPAN}, b {N.SPAN}, reach double, outside boolean, segs {SEGS}, x1 double, y1 double, x2 double, y2 double")
    got = {r.i: r for r in d.select("i", N.strip_cells(*map(F.col, ("a", "b", "reach", "outside"))).alias("cells"), N.line_distance_sq(*map(F.col, ("segs", "x1", "y1", "x2", "y2"))).alias("d")).collect()}
    for i, a, b, reach, outside, segs, *line in rows:
        def near(spans, r, c):
            return any(max(0, s[1] - c - 1, c - s[2]) ** 2 + max(0, abs(s[0] - r) - 1) ** 2 <= reach ** 2 + 1e-9 for s in spans)
        want = {(r, c) for r in range(-9, 25) for c in range(-9, 25) if near(a, r, c) and near(b, r, c)
                and not (outside and any(s[0] == r and s[1] <= c < s[2] for s in a + b))}
        assert {tuple(c) for c in got[i].cells} == want and len(got[i].cells) == len(want)
        cuts = sum((s[1] <= line[1]) != (s[3] <= line[1]) and line[0] < s[0] + (line[1] - s[1]) / (s[3] - s[1]) * (s[2] - s[0]) for s in segs)
        steps = [(line[0] + (line[2] - line[0]) * k / 2000, line[1] + (line[3] - line[1]) * k / 2000) for k in range(2001)]
        about = 0 if cuts % 2 else min(far(p, s) for p in steps for s in segs)
        assert math.sqrt(got[i].d) <= about + 1e-9 and about <= math.sqrt(got[i].d) + 0.006
