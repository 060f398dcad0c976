"""Spatial pair joins: bucketed candidates, exact refinement, copies collapsed first.

Features with identical rings are joined once, as one *shape* with ``members``; a pile of n
copies therefore costs one row, not n squared.  The pair table is at shape level with exact
pair counts and ``expand_pairs`` turns it into feature pairs where a listing is wanted.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions import kernels as N
from gridfold.functions import measures as M
from gridfold.operators import spans as S
from gridfold.session import cut, dealt, pin

BOX = 64  # cells per spatial bucket side


def collapse_copies(features: DataFrame, keys: list[str], fid: str = "feature_id") -> DataFrame:
    """One row per distinct shape: ``keys, rings, shape_id`` (smallest member id), ``members``."""
    return features.groupBy(*keys, "rings").agg(F.min(fid).alias("shape_id"), F.count("*").alias("members"))


def join_rings(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both with equal ``keys`` and rings.  Their hash is the first key, so that the sort compares
    whole rings only where they are equal."""
    h = F.xxhash64("rings").alias("_h")
    return a.select("*", h).join(dealt(b.select("*", h)), ["_h", *keys, "rings"]).drop("_h")


def with_box(df: DataFrame) -> DataFrame:
    """Cell bounding box ``r0, r1, k0, k1`` (half-open) of a span array; NULL when it is empty,
    and such rows then meet nothing in ``box_join``."""
    return pin(df, r0=F.array_min(F.transform("spans", lambda s: s.row)), r1=F.array_max(F.transform("spans", lambda s: s.row)) + 1,
               k0=F.array_min(F.transform("spans", lambda s: s.c0)), k1=F.array_max(F.transform("spans", lambda s: s.c1)))


def with_ring_box(df: DataFrame, res: float) -> DataFrame:
    """A box ``r0, r1, k0, k1`` that holds the cells which ``rings`` may cover, without covering them; shapes too
    thin for any are left out."""
    d, e = pin(df, _b=M.bounds(F.col("rings"))), res * 1e-6

    def cell(v):
        return F.ceil(v / res - 0.5).cast("int")
    box = pin(d, r0=cell(F.col("_b.ymin") - e), r1=cell(F.col("_b.ymax") + e), k0=cell(F.col("_b.xmin") - e), k1=cell(F.col("_b.xmax") + e))
    return box.where("r1 > r0 and k1 > k0").drop("_b")


def _bucketed(df: DataFrame, grow: int, box: int) -> DataFrame:
    def f(c):
        return F.floor(c / box).cast("int")
    return (df.withColumn("by", F.explode(F.sequence(f(F.col("r0") - grow), f(F.col("r1") - 1 + grow))))
            .withColumn("bx", F.explode(F.sequence(f(F.col("k0") - grow), f(F.col("k1") - 1 + grow)))))


def box_join(a: DataFrame, b: DataFrame, keys: list[str], reach: int | None = None, box: int = BOX,
             extra: Column | None = None) -> DataFrame:
    """Rows of ``a`` x ``b`` whose cell boxes overlap, or lie at most ``reach`` cells apart.

    Both sides carry ``r0, r1, k0, k1``; columns of ``b`` come back with prefix ``o_``.  A
    pair found in several buckets is kept only in the bucket of its reference corner, so no
    distinct (and no second shuffle) is needed.
    """
    grow = 0 if reach is None else reach + 1
    left = _bucketed(a, grow, box)
    right = _bucketed(b, 0, box)
    right = right.select([F.col(c).alias(c if c in (*keys, "by", "bx") else f"o_{c}") for c in right.columns])
    near = ((F.col("r0") - grow < F.col("o_r1")) & (F.col("o_r0") < F.col("r1") + grow)
            & (F.col("k0") - grow < F.col("o_k1")) & (F.col("o_k0") < F.col("k1") + grow))
    owner = ((F.col("by") == F.floor(F.greatest(F.col("r0") - grow, F.col("o_r0")) / box))
             & (F.col("bx") == F.floor(F.greatest(F.col("k0") - grow, F.col("o_k0")) / box)))
    out = left.join(dealt(right), [*keys, "by", "bx"]).where(near & owner)
    return (out.where(extra) if extra is not None else out).drop("by", "bx")


def shape_table(features: DataFrame, keys: list[str], res: float, fid: str = "feature_id") -> DataFrame:
    """Collapsed shapes with coverage, box and edges, ready for ``box_join``."""
    shapes = S.coverage(collapse_copies(features, keys, fid), res)
    return with_box(shapes).withColumn("segs", M.segments(F.col("rings")))


def pairs_within(features: DataFrame, keys: list[str], distance: float, res: float) -> DataFrame:
    """Shape pairs with gap <= ``distance`` (a before b): ``keys, a, b, pairs, gap_cells_sq``.

    A shape with several members also pairs with itself (gap 0, n(n-1)/2 pairs).
    """
    shapes = shape_table(features, keys, res).drop("rings", "segs")
    k = int(distance / res + 1e-6)
    two = box_join(shapes, shapes, keys, reach=k, extra=F.col("shape_id") < F.col("o_shape_id"))
    two = two.select(*keys, F.col("shape_id").alias("a"), F.col("o_shape_id").alias("b"),
                     (F.col("members") * F.col("o_members")).alias("pairs"), "spans", "o_spans")
    two = pin(two, gap_cells_sq=S.gap_sq(F.col("spans"), F.col("o_spans"))).drop("spans", "o_spans")
    limit = (distance / res) ** 2 + 1e-6
    return two.where(F.col("gap_cells_sq") <= limit).unionByName(_self_pairs(shapes, keys).withColumn(
        "gap_cells_sq", F.lit(0).cast("long")))


def _self_pairs(shapes: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("members")
    return shapes.where(n > 1).select(*keys, F.col("shape_id").alias("a"), F.col("shape_id").alias("b"),
                                      (n * (n - 1) / 2).cast("long").alias("pairs"))


def overlap_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Intersection of two span-array tables (``keys, id, spans, cells``): ``keys, a, b, inter``.

    Candidates come from one bucketed join; the exact count is a projection of the pair.
    """
    left, right = with_box(a.select(*keys, "id", "spans", "cells")), with_box(b.select(*keys, "id", "spans", "cells"))
    two = box_join(left, right, keys)
    two = two.select(*keys, F.col("id").alias("a"), F.col("o_id").alias("b"), F.col("cells").alias("a_cells"),
                     F.col("o_cells").alias("b_cells"), "spans", "o_spans")
    return pin(two, inter=S.shared_cells(F.col("spans"), F.col("o_spans"))).drop("spans", "o_spans").where("inter > 0")


def total_overlap(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over all feature pairs of the overlap, in cells, without forming any pair:
    a stretch covered n times holds n(n-1)/2 overlapping pairs."""
    return (S.overlay({"n": spans}, keys).where("n > 1").groupBy(*keys)
            .agg(F.sum(S.span_cells() * (F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("overlap_cells")))


def expand_pairs(pairs: DataFrame, features: DataFrame, keys: list[str], fid: str = "feature_id") -> DataFrame:
    """Feature-level listing of a shape-level pair table (the output is as long as the answer)."""
    shapes = collapse_copies(features, keys, fid)
    members = join_rings(features, shapes.select(*keys, "rings", "shape_id"), keys).select(*keys, "shape_id", fid)
    a = members.withColumnsRenamed({"shape_id": "a", fid: "fa"})
    b = members.withColumnsRenamed({"shape_id": "b", fid: "fb"})
    two = pairs.join(a, [*keys, "a"]).join(b, [*keys, "b"])
    same = F.col("a") == F.col("b")
    return (two.where(~same | (F.col("fa") < F.col("fb")))
            .withColumn("feature_a", F.least("fa", "fb")).withColumn("feature_b", F.greatest("fa", "fb")).drop("fa", "fb"))


def nearest_line(features: DataFrame, lines: DataFrame, keys: list[str], fid: str, cell: float, keep: tuple[str, ...] = (), few: int = 64) -> DataFrame:
    """Distance of every outline (``keys, fid, segs``, also ``keep``) to the nearest line segment (``keys, x1,
    y1, x2, y2``), 0 when they meet or the line lies inside; NULL where the keys have no lines.

    The lines of keys that have ``few`` of them go to the outlines as one array; an outline is moved once and
    copied into no bucket.  Where there are more, the search expands (``_search``).
    """
    names = [*keys, fid, *keep]
    features = features.select(*names, "segs")
    many = cut(lines.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > few).select(*keys))
    rest = None
    if not many.isEmpty():
        rest = _search(features.join(dealt(many), keys, "left_semi"), lines.join(dealt(many), keys, "left_semi"), keys, fid, cell, keep)
        features, lines = features.join(dealt(many), keys, "left_anti"), lines.join(dealt(many), keys, "left_anti")
    packed = lines.groupBy(*keys).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_lines"))
    out = features.join(dealt(packed), keys, "left").select(*names, F.sqrt(N.lines_distance_sq(F.col("segs"), F.col("_lines"))).alias("distance"))
    return out if rest is None else out.unionByName(rest)


def _search(features: DataFrame, lines: DataFrame, keys: list[str], fid: str, cell: float, keep: tuple[str, ...]) -> DataFrame:
    """Expanding search: a round looks at the buckets within ``reach`` of the outline's box, keeps
    answers the reach proves, and doubles the reach (and the bucket) for those still open.  It
    ends because only features whose keys have a line take part.
    """
    def ends(a, b):
        return F.flatten(F.transform("segs", lambda s: F.array(s[a], s[b])))
    box = F.struct(F.array_min(ends("x1", "x2")).alias("xmin"), F.array_max(ends("x1", "x2")).alias("xmax"),
                   F.array_min(ends("y1", "y2")).alias("ymin"), F.array_max(ends("y1", "y2")).alias("ymax"))
    todo = features.join(lines.select(*keys).distinct(), keys, "left_semi").select(*keys, fid, "segs")
    todo, done, reach = cut(pin(todo, b=box)), None, cell
    while True:
        p, seg = todo, lines.select(*keys, F.struct("x1", "y1", "x2", "y2").alias("s"))
        for g, lo, hi, u, v in (("gx", "b.xmin", "b.xmax", "s.x1", "s.x2"), ("gy", "b.ymin", "b.ymax", "s.y1", "s.y2")):
            first, last = F.floor(F.least(u, v) / reach), F.floor(F.greatest(u, v) / reach)
            p = p.withColumn(f"{g}0", F.floor((F.col(lo) - reach) / reach)).withColumn(g, F.explode(F.sequence(f"{g}0", F.floor((F.col(hi) + reach) / reach))))
            seg = seg.withColumn(f"{g}1", first).withColumn(g, F.explode(F.sequence(first, last)))
        # a pair that meets in several buckets is measured in the first one only
        near = p.join(dealt(seg), [*keys, "gx", "gy"]).where("gx = greatest(gx0, gx1) and gy = greatest(gy0, gy1)")
        d = N.line_distance_sq(F.col("segs"), F.col("s.x1"), F.col("s.y1"), F.col("s.x2"), F.col("s.y2"))
        best = cut(near.select(*keys, fid, d.alias("d")).groupBy(*keys, fid).agg(F.sqrt(F.min("d")).alias("distance")).where(F.col("distance") <= reach))
        done = best if done is None else done.unionByName(best)
        todo = cut(todo.join(dealt(best), [*keys, fid], "left_anti"))
        if todo.isEmpty():
            return features.select(*keys, fid, *keep).join(dealt(done), [*keys, fid], "left")
        reach *= 2


def neighbour_counts(points: DataFrame, keys: list[str], pid: str, radius: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """Number of other points within ``radius`` (inclusive): ``keys, pid, keep, neighbours``.

    Points are first collapsed to distinct positions with multiplicity.  Cells are two radii wide, so a
    position meets four of them at most.
    """
    reach = math.sqrt(radius * radius + 1e-9) * (1 + 1e-9)
    pos = points.groupBy(*keys, "x", "y").agg(F.count("*").alias("n"))

    def cell(v):
        return F.floor(v / (2 * reach))
    probe = pos.drop("n")
    for g, v in (("gx", F.col("x")), ("gy", F.col("y"))):
        probe = probe.withColumn(g, F.explode(F.sequence(cell(v - reach), cell(v + reach))))
    other = pos.select(*keys, F.col("x").alias("ox"), F.col("y").alias("oy"), "n", cell(F.col("x")).alias("gx"), cell(F.col("y")).alias("gy"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    counts = (probe.join(dealt(other), [*keys, "gx", "gy"]).where(dx * dx + dy * dy <= radius * radius + 1e-9)
              .groupBy(*keys, "x", "y").agg((F.sum("n") - 1).alias("neighbours")))
    return points.join(dealt(counts), [*keys, "x", "y"]).select(*keys, pid, *keep, "neighbours")
