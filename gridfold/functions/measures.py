"""Geometric measures as column expressions over ``rings`` (no shuffle, no Python).

``rings`` is ``array<array<struct<x,y>>>``: closed rings, outer rings counter-clockwise and
holes clockwise (``orient_rings`` normalises input), so signed sums give area and centroid.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def _fold(arr: Column, value) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, s: acc + value(s))


def ring_segments(ring: Column) -> Column:
    n = F.size(ring)
    return F.when(n < 2, F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")).otherwise(
        F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1),
                   lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2"))))


def segments(rings: Column) -> Column:
    """All edges of all rings as one array."""
    return F.flatten(F.transform(rings, ring_segments))


def signed_area(ring: Column) -> Column:
    """Shoelace relative to the first vertex, so large map coordinates do not cancel."""
    o = ring[0]
    return _fold(ring_segments(ring),
                 lambda s: (s.x1 - o.x) * (s.y2 - o.y) - (s.x2 - o.x) * (s.y1 - o.y)) / 2


def canonical_text(rings: Column, res: float) -> Column:
    """Vertices in whole multiples of ``res`` as text, the same for every start and direction of a ring:
    counter-clockwise from the smallest vertex, not closed; rings after the first in sorted order."""
    def one(ring):
        turned = F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)
        points = F.transform(F.slice(turned, 1, F.size(turned) - 1), lambda p: F.struct(F.round(p.x / res).cast("long").alias("x"), F.round(p.y / res).cast("long").alias("y")))
        return let(points, lambda q: let(F.array_position(q, F.array_min(q)), lambda k: F.array_join(F.transform(
            F.concat(F.slice(q, k.cast("int"), F.size(q)), F.slice(q, F.lit(1), (k - 1).cast("int"))), lambda p: F.concat(p.x.cast("string"), F.lit(","), p.y.cast("string"))), " ")))
    texts = F.transform(rings, one)
    return F.array_join(F.concat(F.slice(texts, 1, 1), F.array_sort(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0))))), ";")


def orient_rings(rings: Column) -> Column:
    """First ring counter-clockwise, the others (holes) clockwise."""
    return F.transform(rings, lambda ring, i: F.when(
        (signed_area(ring) < 0) == (i == 0), F.reverse(ring)).otherwise(ring))


def area(rings: Column) -> Column:
    return _fold(rings, signed_area)


def perimeter(rings: Column) -> Column:
    return _fold(segments(rings), lambda s: F.sqrt((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1)))


def compactness(rings: Column) -> Column:
    p = perimeter(rings)
    return F.try_divide(4 * F.pi() * area(rings), p * p)


def bounds(rings: Column) -> Column:
    pts = F.flatten(rings)
    xs, ys = F.transform(pts, lambda p: p.x), F.transform(pts, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
                    F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def centroid(rings: Column) -> Column:
    """Area-weighted centroid; coordinates are shifted to the first vertex while summing."""
    o = rings[0][0]

    def cross(s):
        return (s.x1 - o.x) * (s.y2 - o.y) - (s.x2 - o.x) * (s.y1 - o.y)

    return let(segments(rings), lambda segs: _centroid(segs, o, cross))


def _centroid(segs: Column, o: Column, cross) -> Column:
    a3 = _fold(segs, cross) * 3
    return F.struct(
        (o.x + F.try_divide(_fold(segs, lambda s: cross(s) * (s.x1 + s.x2 - 2 * o.x)), a3)).alias("x"),
        (o.y + F.try_divide(_fold(segs, lambda s: cross(s) * (s.y1 + s.y2 - 2 * o.y)), a3)).alias("y"))


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    def p(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(p(xmin, ymin), p(xmax, ymin), p(xmax, ymax), p(xmin, ymax), p(xmin, ymin))


def length(line: Column) -> Column:
    return _fold(ring_segments(line), lambda s: F.hypot(s.x2 - s.x1, s.y2 - s.y1))


def point_segment_sq(px: Column, py: Column, s: Column) -> Column:
    """Squared distance of a point to a segment."""
    dx, dy = s.x2 - s.x1, s.y2 - s.y1
    t = F.coalesce(F.try_divide((px - s.x1) * dx + (py - s.y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    ex, ey = px - s.x1 - t * dx, py - s.y1 - t * dy
    return ex * ex + ey * ey


def boundary_samples(segs: Column, step: float) -> Column:
    """Mid-points of equal pieces (at most ``step`` long) of every segment, with piece length."""
    def pieces(s):
        ln = F.hypot(s.x2 - s.x1, s.y2 - s.y1)
        n = F.greatest(F.lit(1), F.ceil(ln / step - 1e-6).cast("int"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
            (s.x1 + (s.x2 - s.x1) * (i + 0.5) / n).alias("x"),
            (s.y1 + (s.y2 - s.y1) * (i + 0.5) / n).alias("y"), (ln / n).alias("w")))
    return F.flatten(F.transform(F.filter(segs, lambda s: (s.x1 != s.x2) | (s.y1 != s.y2)), pieces))


def seam_distance(c: Column, r: Column, stride: int, px: float) -> Column:
    """Distance in metres from pixel position (c, r) to the nearest tile seam."""
    def near(v):
        m = F.pmod(v, F.lit(stride))
        return F.least(m, stride - m)
    return F.least(near(c), near(r)) * px


def equivalent_diameter(a: Column) -> Column:
    return 2 * F.sqrt(a / F.pi())


def pixel_to_map(col: Column, row: Column, left: Column, top: Column, res: Column) -> Column:
    """North-up affine: pixel corner (col, row) to map (x, y)."""
    return F.struct((left + col * res).alias("x"), (top - row * res).alias("y"))


def map_to_pixel(x: Column, y: Column, left: Column, top: Column, res: Column) -> Column:
    return F.struct(((x - left) / res).alias("col"), ((top - y) / res).alias("row"))


def confidence(score: Column, label: Column) -> Column:
    """Struct only when a score exists, else NULL."""
    return F.when(score.isNotNull(), F.struct(score.alias("value"), label.alias("kind"),
                                              F.lit(False).alias("calibrated")))
