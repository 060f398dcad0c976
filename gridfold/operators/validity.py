"""Polygons against themselves, across all of their rings, and layers against their mask."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions import kernels as N
from gridfold.functions import measures as M
from gridfold.operators import spans as S
from gridfold.operators.topology import _between, _turn, edge_count, ring_structure, segments_meet
from gridfold.session import cut, dealt, pin

def _edges(features: DataFrame, fid: list[str]) -> DataFrame:
    """Edges of all rings: ``fid, ring, n, i, s, side, xmin, ymin``.  ``side`` is the feature's box
    divided by the root of its edge count, so a bucket meets a bounded share of the edges."""
    boxed = pin(features.select(*fid, "rings"), b=M.bounds(F.col("rings")), m=F.aggregate("rings", F.lit(0), lambda a, r: a + F.size(r) - 1))
    side = F.greatest(F.greatest(F.col("b.xmax") - F.col("b.xmin"), F.col("b.ymax") - F.col("b.ymin")) / F.sqrt("m"), F.lit(1e-6))
    rings = boxed.select(*fid, F.col("b.xmin").alias("xmin"), F.col("b.ymin").alias("ymin"), side.alias("side"), F.posexplode("rings").alias("ring", "pts"))
    return rings.select(*fid, "ring", "xmin", "ymin", "side", (F.size("pts") - 1).alias("n"), F.posexplode(M.ring_segments(F.col("pts"))).alias("i", "s"))


def _bucketed(edges: DataFrame) -> DataFrame:
    """Edges in the buckets they pass: per column only the rows of the edge's own stretch, so a
    slanting edge does not fill its box."""
    side, s = F.col("side"), F.col("s")
    out = edges.withColumn("bx", F.explode(F.sequence(F.floor((F.least(s.x1, s.x2) - F.col("xmin")) / side), F.floor((F.greatest(s.x1, s.x2) - F.col("xmin")) / side))))
    slope = F.when(s.x1 != s.x2, (s.y2 - s.y1) / (s.x2 - s.x1))

    def at(x):  # height of the edge where it enters or leaves the column
        return s.y1 + slope * (F.least(F.greatest(x, F.least(s.x1, s.x2)), F.greatest(s.x1, s.x2)) - s.x1)
    left = F.col("xmin") + F.col("bx") * side
    a, b = at(left), at(left + side)
    slack = side * 1e-6
    low = F.coalesce(F.least(a, b), F.least(s.y1, s.y2)) - slack
    high = F.coalesce(F.greatest(a, b), F.greatest(s.y1, s.y2)) + slack
    return out.withColumn("by", F.explode(F.sequence(F.floor((low - F.col("ymin")) / side), F.floor((high - F.col("ymin")) / side))))


def _cross(s, t) -> Column:
    """Two edges cross between their ends, or lie on each other along more than a point."""
    a, b, c, d = (s.x1, s.y1), (s.x2, s.y2), (t.x1, t.y1), (t.x2, t.y2)
    proper = (_turn(a, b, c) * _turn(a, b, d) < 0) & (_turn(c, d, a) * _turn(c, d, b) < 0)
    on_line = (_turn(a, b, c) == 0) & (_turn(a, b, d) == 0)

    def reach(p1, p2, q1, q2):
        return F.least(F.greatest(p1, p2), F.greatest(q1, q2)) - F.greatest(F.least(p1, p2), F.least(q1, q2))
    dx, dy = reach(s.x1, s.x2, t.x1, t.x2), reach(s.y1, s.y2, t.y1, t.y2)
    return proper | (on_line & (dx >= 0) & (dy >= 0) & ((dx > 0) | (dy > 0)))


def polygon_faults(features: DataFrame, fid: list[str], few: int = N.FEW) -> DataFrame:
    """``fid, faults`` for every feature: ring 0 is the shell, the others are holes.

    Structure first (empty, open, too few points, not finite); what is whole is tested across all
    rings: ``self_intersection`` (a ring meets itself), ``rings_cross`` (edges of two rings cross or
    share a stretch; touching in a point is allowed), ``hole_outside`` (a vertex of a hole lies
    outside the shell), ``nested_holes`` (a vertex of a hole lies inside another hole).  A polygon of at
    most ``few`` edges is tested in its row, without a shuffle; edges of larger ones meet in buckets and
    their vertices are cast along strips, so no large ring is squared in one row.
    """
    seen = pin(features.select(*fid, "rings"), _codes=ring_structure(F.col("rings")), _edges=edge_count(F.col("rings")))
    rest = F.expr(f"size(_codes) = 0 and _edges > {few}")
    across = N.ring_codes(F.when((F.size("_codes") == 0) & ~rest, F.col("rings")))
    out = pin(seen.where(~rest), _across=across).select(*fid, F.when(F.size("_codes") > 0, F.col("_codes")).otherwise(F.col("_across")).alias("faults"))
    large = cut(seen.where(rest).select(*fid, "rings"))
    return out if large.isEmpty() else out.unionByName(_large_faults(large, fid))


def _large_faults(features: DataFrame, fid: list[str]) -> DataFrame:
    """``fid, faults`` of sound rings with very many edges."""
    edges = cut(_edges(features, fid))
    bucketed = _bucketed(edges).select(*fid, "bx", "by", "ring", "n", "i", "s")
    other = bucketed.select(*fid, "bx", "by", F.col("ring").alias("ring2"), F.col("i").alias("j"), F.col("s").alias("t"))
    met = bucketed.join(dealt(other), [*fid, "bx", "by"]).where("ring < ring2 or (ring = ring2 and i + 1 < j and not (i = 0 and j = n - 1))")
    code = F.when((F.col("ring") == F.col("ring2")) & segments_meet(F.col("s"), F.col("t")), "self_intersection").when(
        (F.col("ring") < F.col("ring2")) & _cross(F.col("s"), F.col("t")), "rings_cross")
    met = met.select(*fid, code.alias("code")).where("code is not null")

    many = edges.groupBy(*fid).agg(F.max("ring").alias("_last")).where("_last > 0").select(*fid)
    holed = edges.join(dealt(many), fid, "left_semi")
    strip = lambda y: F.floor((y - F.col("ymin")) / F.col("side"))
    points = holed.where("ring > 0").select(*fid, "ring", "n", "i", F.col("s.x1").alias("x"), F.col("s.y1").alias("y"), strip(F.col("s.y1")).alias("by"))
    walls = holed.select(*fid, F.col("ring").alias("wall"), "s", F.explode(F.sequence(strip(F.least("s.y1", "s.y2")), strip(F.greatest("s.y1", "s.y2")))).alias("by"))
    a, b, p = (F.col("s.x1"), F.col("s.y1")), (F.col("s.x2"), F.col("s.y2")), (F.col("x"), F.col("y"))
    crosses = ((a[1] > p[1]) != (b[1] > p[1])) & (p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0])
    on = (_turn(a, b, p) == 0) & _between(a, b, p)
    cast = points.join(dealt(walls), [*fid, "by"]).where("ring <> wall").groupBy(*fid, "ring", "n", "i", "wall").agg(
        (F.count_if(crosses) % 2 == 1).alias("_in"), F.bool_or(on).alias("_on"))
    inner = cast.where("wall > 0 and _in and not _on").select(*fid, F.lit("nested_holes").alias("code"))
    held = cast.where("wall = 0 and (_in or _on)").groupBy(*fid, "ring").agg(F.count("*").alias("_held"))
    holes = holed.where("ring > 0").groupBy(*fid, "ring").agg(F.first("n").alias("n"))
    loose = holes.join(dealt(held), [*fid, "ring"], "left").where("coalesce(_held, 0) < n").select(*fid, F.lit("hole_outside").alias("code"))
    codes = met.unionByName(inner).unionByName(loose).groupBy(*fid).agg(F.array_sort(F.collect_set("code")).alias("_across"))
    return features.join(dealt(codes), fid, "left").select(*fid, F.coalesce("_across", F.array().cast("array<string>")).alias("faults"))


def layer_checks(features: DataFrame, mask: DataFrame, nodata: DataFrame, sites: DataFrame, keys: list[str], res: float,
                 min_area: float, least_iou: float = 0.85, fid: str = "feature_id") -> DataFrame:
    """Rows ``keys, check, passed, detail`` of a layer (``keys, fid, rings``) against its raster.

    ``mask`` and ``nodata`` hold cells (``keys, row, col``), the mask also as spans (``keys, row, c0, c1``); ``sites`` holds per key the recorded
    ``features`` and the extent ``xmin, ymin, xmax, ymax``.  Checks: count as recorded; polygons
    valid; inside the extent; not below the least area; IoU of the burned polygons with the mask;
    interior points on cells with data.  ``detail`` is the number of faults, or the IoU.  A site
    without features or without mask cells is listed too (an empty union has IoU 1).
    """
    bare = features.select(*keys, fid, "rings")
    bad = polygon_faults(bare, [*keys, fid]).where("size(faults) > 0").groupBy(*keys).agg(F.count("*").alias("invalid"))
    e = 1e-6
    out = (F.col("_b.xmin") < F.col("xmin") - e) | (F.col("_b.xmax") > F.col("xmax") + e) | (F.col("_b.ymin") < F.col("ymin") - e) | (F.col("_b.ymax") > F.col("ymax") + e)
    plain = pin(bare, _a=M.area(F.col("rings")), _b=M.bounds(F.col("rings"))).select(*keys, "_a", "_b").join(dealt(sites.drop("features")), keys).groupBy(*keys).agg(F.count("*").alias("found"), F.count_if(out).alias("outside"), F.count_if(F.col("_a") < min_area - 1e-9).alias("small"))
    d = S.coverage(bare, res).select(*keys, "spans")
    cell = pin(d, _p=S.interior_point(F.col("spans"), res)).select(*keys, F.floor(F.col("_p.y") / res + 1e-9).cast("int").alias("row"), F.floor(F.col("_p.x") / res + 1e-9).cast("int").alias("col"))
    dark = cell.groupBy(*keys, "row", "col").agg(F.count("*").alias("_n")).join(dealt(nodata.select(*keys, "row", "col").distinct()), [*keys, "row", "col"]).groupBy(*keys).agg(F.sum("_n").alias("dark"))
    spans = mask if "c0" in mask.columns else mask.select(*keys, "row", F.col("col").alias("c0"), (F.col("col") + 1).alias("c1"))
    both = S.bit_rows({"v": S.explode_spans(d, *keys), "m": spans}, keys).groupBy(*keys).agg(
        F.sum(F.bit_count(F.expr("v & m")).cast("long")).alias("_inter"), F.sum(F.bit_count(F.expr("v | m")).cast("long")).alias("_union"))
    all_ = sites.select(*keys, "features")
    for part in (plain, bad, dark, both):
        all_ = all_.join(part, keys, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    iou = F.when(n("_union") > 0, n("_inter") / n("_union")).otherwise(1.0)
    rows = {"feature_count": F.abs(n("found") - n("features")), "valid": n("invalid"), "inside_bounds": n("outside"), "min_area": n("small"), "interior_points": n("dark")}
    checks = [F.struct(F.lit(k).alias("check"), (v == 0).alias("passed"), v.alias("detail")) for k, v in rows.items()]
    checks.append(F.struct(F.lit("round_trip").alias("check"), (iou >= least_iou).alias("passed"), iou.alias("detail")))
    return all_.select(*keys, F.inline(F.array(*checks)))
