"""Topology checks between footprints: duplicates, overlaps, shared edges, gaps, validity, flags."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold import settings as T
from gridfold.functions import kernels as N
from gridfold.functions import measures as M
from gridfold.operators import pairs as P
from gridfold.operators import spans as S
from gridfold.operators.hulls import region_sides
from gridfold.operators.components import cell_components, label_block
from gridfold.operators.order import number_in_order
from gridfold.session import cut, dealt, pin

KEYS = ["site_id", "feature_type"]


def pair_relations(features: DataFrame, res: float, tol: float = T.SHARED_TOL, keys: list[str] = KEYS) -> DataFrame:
    """Relation of every two shapes of one class that come within ``tol``:

    duplicate (IoU >= .9), else overlap (>= .25 m2 and >= 5 % of the smaller), else shared
    boundary (run of at least .5 m within ``tol``); others are left out.  Output: ``keys, a,
    b, pairs, relation, iou, overlap_m2, fraction, length_m, severity``.  Shapes that occur
    several times also relate to themselves (duplicates).
    """
    shapes = P.collapse_copies(features, keys)
    k = int(tol / res + 1e-6)
    boxed = P.with_ring_box(shapes, res)  # rings go through the join, a fifth of their spans and edges
    two = P.box_join(boxed, boxed, keys, reach=k, extra=F.col("shape_id") < F.col("o_shape_id"))
    for o in ("", "o_"):
        two = S.coverage(two.withColumn(f"{o}segs", M.segments(F.col(f"{o}rings"))), res, f"{o}rings", o)
    two = pin(two, inter=S.shared_cells(F.col("spans"), F.col("o_spans")), gap=S.gap_sq(F.col("spans"), F.col("o_spans")))
    two = two.where(F.col("gap") <= (tol / res) ** 2 + 1e-6)
    iou = F.col("inter") / (F.col("cells") + F.col("o_cells") - F.col("inter"))
    frac = F.col("inter") / F.least("cells", "o_cells")
    overlap_m2 = F.col("inter") * (res * res)
    big = (overlap_m2 >= T.OVERLAP_MIN_AREA - T.EPS) & (frac >= T.OVERLAP_MIN_FRACTION)
    run = N.covered_length(F.col("o_segs"), F.col("segs"), res, tol)
    two = pin(two.withColumn("iou", iou).withColumn("fraction", frac).withColumn("overlap_m2", overlap_m2),
              length_m=F.when((F.col("iou") < T.DUPLICATE_IOU) & ~big, run))
    relation = (F.when(F.col("iou") >= T.DUPLICATE_IOU, "duplicate").when(big, "overlap")
                .when(F.col("length_m") >= T.SHARED_MIN_LENGTH - 1e-6, "shared_boundary"))
    out = two.select(*keys, F.col("shape_id").alias("a"), F.col("o_shape_id").alias("b"),
                     (F.col("members") * F.col("o_members")).alias("pairs"), relation.alias("relation"), "iou",
                     "overlap_m2", "fraction", F.coalesce("length_m", F.lit(0.0)).alias("length_m")).where("relation is not null")
    same = S.coverage(shapes.where("members > 1"), res).withColumn("overlap_m2", F.col("cells") * (res * res))
    same = same.withColumnRenamed("shape_id", "a").withColumn("b", F.col("a")).withColumn("pairs", (F.col("members") * (F.col("members") - 1) / 2).cast("long"))
    same = same.select(*keys, "a", "b", "pairs", F.lit("duplicate").alias("relation"), F.lit(1.0).alias("iou"), "overlap_m2",
                       F.lit(1.0).alias("fraction"), F.lit(0.0).alias("length_m"))
    return out.unionByName(same).withColumn("severity", severity(F.col("relation"), F.col("fraction")))


def severity(relation: Column, fraction: Column) -> Column:
    """Errors: invalid, duplicate, overlap of at least 30 % of the smaller; relations have none."""
    return (F.when(relation.isin("invalid_geometry", "duplicate"), "error")
            .when(relation == "overlap", F.when(fraction >= T.OVERLAP_ERROR_FRACTION, "error").otherwise("warning"))
            .when(relation == "gap_sliver", "warning").otherwise("none"))


def conflict_table(features: DataFrame, res: float, keys: list[str] = KEYS) -> DataFrame:
    """Everything that speaks about a layer, in the columns of ``pair_relations``: features with
    broken rings (``a`` = ``b`` = the feature), relations and gap slivers (``a``: smallest feature at the
    gap, ``b``: the gap) of the features that are whole."""
    seen = with_broken(features.select(*keys, "feature_id", "rings"))
    whole = seen.where("not _broken").drop("_broken")
    two = pair_relations(whole, res, keys=keys)
    spans = S.coverage(whole, res).withColumnRenamed("feature_id", "id").select(*keys, "id", "spans")
    gaps = gap_conflicts(spans, res, keys).select(*keys, F.col("first_feature").alias("a"), F.col("gap").alias("b"), F.lit("gap_sliver").alias("relation"))
    broken = seen.where("_broken").select(*keys, F.col("feature_id").alias("a"), F.col("feature_id").alias("b"), F.lit("invalid_geometry").alias("relation"))
    rest = gaps.unionByName(broken).withColumn("pairs", F.lit(1).cast("long"))
    for c in ("iou", "overlap_m2", "fraction", "length_m"):
        rest = rest.withColumn(c, F.lit(0.0))
    return two.unionByName(rest.withColumn("severity", severity(F.col("relation"), F.col("fraction"))))


def relation_summary(relations: DataFrame, layers: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by type and severity, shared-boundary count and the valid flag of every layer
    listed (``keys``); a layer without any row is valid."""
    n = F.col("pairs")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0).cast("long"))

    rel, sev = F.col("relation"), F.col("severity")
    counts = relations.groupBy(*keys).agg(
        total(rel == "invalid_geometry").alias("invalid"), total(rel == "gap_sliver").alias("gaps"), total(rel == "duplicate").alias("duplicates"), total(rel == "overlap").alias("overlapping"),
        total(sev == "error").alias("errors"), total(sev == "warning").alias("warnings"),
        total(rel == "shared_boundary").alias("shared_boundaries"), (total(sev != "none") == 0).alias("valid"))
    names = [c for c in counts.columns if c not in keys and c != "valid"]
    return layers.select(*keys).distinct().join(dealt(counts), keys, "left").na.fill(0, names).na.fill(True, ["valid"])


def number_conflicts(relations: DataFrame) -> DataFrame:
    """Conflict order per site: invalid, duplicate, overlap, gap; then ids; ``conflict-001`` ..."""
    rank = F.create_map(*[F.lit(v) for kv in {"invalid_geometry": 0, "duplicate": 1, "overlap": 2, "gap_sliver": 3}.items() for v in kv])
    rows = relations.where("severity <> 'none'").withColumn("rank", rank[F.col("relation")])
    block = F.col("rank").cast("long") * (1 << 40) + F.floor(F.col("a") / 65536)
    out = number_in_order(rows, ["site_id"], ["rank", "a", "b", "feature_type"], "n", block)
    return out.withColumn("conflict_id", F.format_string("conflict-%03d", "n"))


def shared_edge_at_vertex(features: DataFrame, vertices: DataFrame, res: float, tol: float = T.SHARED_TOL, keys: list[str] = KEYS) -> DataFrame:
    """For each vertex (``keys, target, x, y``; target is a shape id) the neighbour sharing the
    edge there: boundary within ``tol`` of the vertex and a shared run of at least .5 m;
    nearest first, ties by id.  Vertices without such a neighbour are left out."""
    shapes = P.shape_table(features, keys, res).drop("rings", "cells")
    k = int(tol / res + 1e-6)
    v = vertices.withColumn("spans", F.array(F.struct(F.floor(F.col("y") / res).cast("int").alias("row"),
                            F.floor(F.col("x") / res).cast("int").alias("c0"), (F.floor(F.col("x") / res) + 1).cast("int").alias("c1"))))
    v = P.with_box(v).drop("spans")
    near = P.box_join(v, shapes.drop("spans"), keys, reach=k + 1, extra=F.col("target") != F.col("o_shape_id"))
    near = pin(near, d=N.point_distance(F.col("x"), F.col("y"), F.col("o_segs"))).where(F.col("d") <= tol + T.EPS)
    near = near.select(*keys, "target", "x", "y", "d", F.col("o_shape_id").alias("neighbour"), "o_segs")
    both = near.join(dealt(shapes.select(*keys, F.col("shape_id").alias("target"), "segs")), [*keys, "target"])
    both = pin(both, length_m=N.covered_length(F.col("o_segs"), F.col("segs"), res, tol))
    both = both.where(F.col("length_m") >= T.SHARED_MIN_LENGTH - 1e-6)
    best = both.groupBy(*keys, "target", "x", "y").agg(F.min(F.struct(F.round("d", 6).alias("d"), "neighbour", "length_m")).alias("m"),
                                                      F.count("*").alias("candidates"))
    return best.select(*keys, "target", "x", "y", "m.neighbour", F.col("m.d").alias("distance_m"), "m.length_m", "candidates")


def _disc(grid: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros_like(grid)
    for dr, dc in offsets:
        out |= np.roll(grid, (dr, dc), (0, 1))
    return out


def closing_gaps(features: DataFrame, res: float, width: float = T.GAP_MAX_WIDTH, keys: list[str] = KEYS, tile: int = 256,
                 min_area: float = 0.0, min_length: float = 0.0) -> DataFrame:
    """Cells of narrow gaps: morphological closing of the union minus the union.

    Span arrays go to the tiles that they meet with a halo of twice the radius, so one shuffle feeds
    both the dilation and the erosion; a tile paints them as they come and holds its own area, however many there are.
    4-connected gaps that lie inside a tile and are below ``min_area``, or shorter than ``min_length`` in any direction, are left out.
    """
    reach = width / 2 / res
    k = int(reach)
    halo = 2 * k + 1
    n = tile + 2 * halo
    disc = [(dr, dc) for dr in range(-k, k + 1) for dc in range(-k, k + 1) if dr * dr + dc * dc <= reach * reach]

    def tiles(lo, hi):
        return F.explode(F.sequence(F.floor((lo - halo) / tile).cast("int"), F.floor((hi - 1 + halo) / tile).cast("int")))

    r0, c0 = F.col("_tr") * tile - halo, F.col("_tc") * tile - halo
    boxed = P.with_box(features.select(*keys, "spans"))
    placed = boxed.where("r1 > r0").withColumn("_tr", tiles(F.col("r0"), F.col("r1"))).withColumn("_tc", tiles(F.col("k0"), F.col("k1")))
    inside = (F.col("r0") >= r0) & (F.col("r1") <= r0 + n) & (F.col("k0") >= c0) & (F.col("k1") <= c0 + n)
    part = F.when(inside, F.col("spans")).otherwise(F.filter("spans", lambda s: (s.row >= r0) & (s.row < r0 + n) & (s.c1 > c0) & (s.c0 < c0 + n)))
    placed = pin(placed, _part=part).where(F.size("_part") > 0).select(*keys, "_tr", "_tc", N.packed_spans(F.col("_part")).alias("_part"))
    head = ", ".join(f"{c} {features.schema[c].dataType.simpleString()}" for c in keys)

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union = np.zeros((n, n), bool)
        for batch in batches:
            first = [batch.column(c)[0] for c in (*keys, "_tr", "_tc")]
            top, left = (v.as_py() * tile - halo for v in first[-2:])
            row, a, b = N.unpacked_spans(batch.column("_part")).T - np.array([[top], [left], [left]])
            line = row * (n + 1)
            steps = np.bincount(line + np.clip(a, 0, n), minlength=n * (n + 1)) - np.bincount(line + np.clip(b, 0, n), minlength=n * (n + 1))
            union |= np.cumsum(steps.reshape(n, n + 1), axis=1)[:, :n] > 0
        closed = ~_disc(~_disc(union, disc), disc) & ~union
        rr, cc = np.nonzero(closed[halo:-halo, halo:-halo])
        if len(rr):
            _, gap, cells = np.unique(label_block(rr, cc, rr * tile + cc), return_inverse=True, return_counts=True)
            lo, hi = (np.full((2, len(cells)), v) for v in (tile, -1))
            for i, v in enumerate((rr, cc)):
                np.minimum.at(lo[i], gap, v)
                np.maximum.at(hi[i], gap, v)
            big = (cells * res * res >= min_area - T.EPS) & (np.hypot(*(hi - lo + 1)) * res >= min_length - T.EPS)
            keep = (big | (lo == 0).any(axis=0) | (hi == tile - 1).any(axis=0))[gap]
            rr, cc = rr[keep] + halo, cc[keep] + halo
        yield pa.RecordBatch.from_arrays([*(pa.repeat(v, len(rr)) for v in first[:-2]), pa.array((rr + top).astype(np.int32)), pa.array((cc + left).astype(np.int32))], [*keys, "row", "col"])

    return placed.groupBy(*keys, "_tr", "_tc").applyInArrow(gaps, head + ", row int, col int")


def gap_conflicts(features: DataFrame, res: float, keys: list[str] = KEYS, fid: str = "id",
                  min_area: float = T.GAP_MIN_AREA, min_length: float = T.GAP_MIN_LENGTH, width: float = T.GAP_MAX_WIDTH) -> DataFrame:
    """Gap slivers: 4-connected gap regions of at least .1 m2 and 1 m (longer side of the smallest rotated
    rectangle) that touch two or more footprints: ``keys, gap, cells, length_m, features, first_feature``."""
    comp = cut(cell_components(closing_gaps(features, res, width, keys, min_area=min_area, min_length=min_length), keys, tile=512))
    size = comp.groupBy(*keys, "component").agg(
        F.count("*").alias("cells"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("k0"), F.max("col").alias("k1"))
    across = F.hypot(F.col("r1") - F.col("r0") + 1, F.col("k1") - F.col("k0") + 1)  # no side is longer than this
    size = cut(size.where((F.col("cells") * res * res >= min_area - T.EPS) & (across * res >= min_length - T.EPS)).select(*keys, "component", "cells"))
    sides = region_sides(cut(comp.join(dealt(size.select(*keys, "component")), [*keys, "component"], "left_semi")), [*keys, "component"])
    big = cut(size.join(dealt(sides.where(F.col("long_side") * res >= min_length - T.EPS)), [*keys, "component"])
              .select(*keys, "component", "cells", (F.col("long_side") * res).alias("length_m")))
    rim = comp.join(dealt(big.select(*keys, "component")), [*keys, "component"]).select(
        *keys, "component", F.explode(F.array(F.col("row") - 1, F.col("row"), F.col("row") + 1)).alias("row"),
        (F.col("col") - 1).alias("c0"), (F.col("col") + 2).alias("c1"))
    rim = S.split_spans(S.union_spans(rim, [*keys, "component"]))
    owner = S.split_spans(S.explode_spans(features, *keys, fid)).withColumnsRenamed({"c0": "f0", "c1": "f1"})
    near = rim.join(dealt(owner), [*keys, "row", "bucket"]).where("f0 < c1 and c0 < f1")
    ids = cut(near.groupBy(*keys, "component").agg(F.count_distinct(fid).alias("features"), F.min(fid).alias("first_feature")))
    return big.join(dealt(ids), [*keys, "component"]).where("features >= 2").withColumnRenamed("component", "gap")


def _turn(p, q, r):
    return F.signum((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))


def _between(p, q, r):
    """r on the box of p-q (used when collinear)."""
    return (F.least(p[0], q[0]) <= r[0]) & (r[0] <= F.greatest(p[0], q[0])) & (F.least(p[1], q[1]) <= r[1]) & (r[1] <= F.greatest(p[1], q[1]))


def segments_meet(s, t) -> Column:
    a, b, c, d = (s.x1, s.y1), (s.x2, s.y2), (t.x1, t.y1), (t.x2, t.y2)
    o1, o2, o3, o4 = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    return (((o1 != o2) & (o3 != o4)) | ((o1 == 0) & _between(a, b, c)) | ((o2 == 0) & _between(a, b, d))
            | ((o3 == 0) & _between(c, d, a)) | ((o4 == 0) & _between(c, d, b)))


def ring_crosses(ring: Column) -> Column:
    """Any two non-neighbouring edges of a closed ring meet (for rings of moderate size)."""
    segs = F.transform(M.ring_segments(ring), lambda s, i: F.struct(s.x1, s.y1, s.x2, s.y2, i.alias("i")))
    return M.let(segs, lambda sg: F.exists(sg, lambda s: F.exists(sg, lambda t: (
        (s["i"] + 1 < t["i"]) & ~((s["i"] == 0) & (t["i"] == F.size(sg) - 1)) & segments_meet(s, t)))))


def crossing_rings(features: DataFrame, fid: list[str], edge: Column | None = None) -> DataFrame:
    """Ids of features whose (possibly huge) outline meets itself, by a bucketed edge join.

    The bucket side is the outline's box divided by the square root of its edge count, so each
    edge meets a bounded number of others whatever the outline's size.
    """
    boxed = pin(features.select(*fid, "rings"), b=M.bounds(F.col("rings")))
    base = boxed.select(*fid, "b", F.posexplode("rings").alias("ring", "pts"))
    base = base.withColumn("n", F.size("pts") - 1).withColumn(
        "side", F.greatest(F.greatest(F.col("b.xmax") - F.col("b.xmin"), F.col("b.ymax") - F.col("b.ymin")) / F.sqrt("n"), F.lit(1e-6)))
    seg = base.select(*fid, "ring", "n", "side", "b", F.posexplode(M.ring_segments(F.col("pts"))).alias("i", "s"))
    f = lambda v, o: F.floor((v - o) / F.col("side"))
    seg = (seg.withColumn("bx", F.explode(F.sequence(f(F.least("s.x1", "s.x2"), F.col("b.xmin")), f(F.greatest("s.x1", "s.x2"), F.col("b.xmin")))))
           .withColumn("by", F.explode(F.sequence(f(F.least("s.y1", "s.y2"), F.col("b.ymin")), f(F.greatest("s.y1", "s.y2"), F.col("b.ymin"))))))
    a = seg.select(*fid, "ring", "n", "bx", "by", "i", "s")
    o = seg.select(*fid, "ring", "bx", "by", F.col("i").alias("j"), F.col("s").alias("t"))
    hit = a.join(dealt(o), [*fid, "ring", "bx", "by"]).where("i + 1 < j and not (i = 0 and j = n - 1)").where(segments_meet(F.col("s"), F.col("t")))
    return hit.select(*fid).distinct()


def ring_structure(rings: Column) -> Column:
    """Codes of rings that are no rings: empty, open, too few points, non-finite."""
    pts = F.flatten(rings)
    bad_number = F.exists(pts, lambda p: F.isnan(p.x) | F.isnan(p.y) | (F.abs(p.x) == float("inf")) | (F.abs(p.y) == float("inf")))
    empty = (F.size(rings) == 0) | F.exists(rings, lambda r: F.size(r) == 0)
    opened = F.exists(rings, lambda r: (r[0].x != r[F.size(r) - 1].x) | (r[0].y != r[F.size(r) - 1].y))
    few = F.exists(rings, lambda r: F.size(r) < 4)
    return F.array_compact(F.array(F.when(empty, F.lit("empty")), F.when(~empty & opened, F.lit("not_closed")),
                                   F.when(~empty & few, F.lit("too_few_points")), F.when(bad_number, F.lit("not_finite"))))


def edge_count(rings: Column) -> Column:
    return F.coalesce(F.aggregate(rings, F.lit(0), lambda a, r: a + F.size(r) - 1), F.lit(0))


def with_broken(features: DataFrame) -> DataFrame:
    """Adds ``_broken``: ``ring_faults`` has a code.  Polygons of few edges are tested a batch at once."""
    rings = F.col("rings")
    d = pin(features, _odd=F.size(ring_structure(rings)) > 0, _few=edge_count(rings) <= N.FEW)
    d = pin(d, _codes=N.ring_codes(F.when(~F.col("_odd") & F.col("_few"), rings)))
    crossed = F.when(F.col("_few"), F.array_contains("_codes", "self_intersection")).otherwise(F.exists(rings, ring_crosses))
    return pin(d, _broken=F.col("_odd") | crossed).drop("_odd", "_few", "_codes")


def ring_faults(rings: Column) -> Column:
    """Codes of broken rings, ring by ring: those of ``ring_structure`` and self-intersecting
    (``validity.polygon_faults`` tests rings against each other)."""
    codes = ring_structure(rings)
    shaped = ~F.exists(codes, lambda c: c != "not_finite")
    crossed = F.when(shaped, F.exists(rings, ring_crosses)).otherwise(F.lit(False))
    return F.when(crossed, F.array_append(codes, F.lit("self_intersection"))).otherwise(codes)


def display_flags(area: Column, has_neighbour: Column, score: Column, merged_layer: bool,
                  small=T.SMALL_AREA, large=T.LARGE_AREA, low=T.LOW_SCORE) -> Column:
    """Display cues of a footprint; the neighbour cue is named by the kind of layer."""
    return F.array_compact(F.array(
        F.when(area < small, F.lit("small_roof")),
        F.when((area > large) & F.lit(merged_layer), F.lit("possible_merged_buildings")),
        F.when(has_neighbour, F.lit("touching_neighbour" if merged_layer else "possible_over_split")),
        F.when(score < low, F.lit("low_score"))))


def with_neighbour_flag(features: DataFrame, res: float, distance: float = T.TOUCH_DISTANCE) -> DataFrame:
    """Adds ``has_neighbour``: some other feature of the site lies within ``distance``."""
    pairs = P.pairs_within(features, ["site_id"], distance, res)
    near = pairs.select("site_id", F.explode(F.array("a", "b")).alias("shape_id")).distinct().withColumn("has_neighbour", F.lit(True))
    shapes = P.collapse_copies(features, ["site_id"]).join(dealt(near), ["site_id", "shape_id"], "left").select(
        "site_id", "rings", F.coalesce("has_neighbour", F.lit(False)).alias("has_neighbour"))
    return P.join_rings(features, shapes, ["site_id"])


def coordinate_codes(rings: Column, geographic: Column, site: Column | None = None) -> Column:
    """Error codes of coordinate gates: range of lon/lat or UTM, distance to the site extent."""
    b = M.bounds(rings)
    lonlat = (b.xmin >= -180) & (b.xmax <= 180) & (b.ymin >= -90) & (b.ymax <= 90)
    utm = (b.xmin >= 0) & (b.xmax <= 1_000_000) & (b.ymin >= 0) & (b.ymax <= 10_000_000)
    finite = ~F.exists(F.flatten(rings), lambda p: F.isnan(p.x) | F.isnan(p.y) | (F.abs(p.x) == float("inf")) | (F.abs(p.y) == float("inf")))
    codes = [F.when(~finite, F.lit("not_finite")), F.when(finite & geographic & ~lonlat, F.lit("lonlat_range")),
             F.when(finite & ~geographic & ~utm, F.lit("utm_range"))]
    if site is not None:
        p = T.COORD_PAD_DEG
        out = (b.xmax < site.xmin - p) | (b.xmin > site.xmax + p) | (b.ymax < site.ymin - p) | (b.ymin > site.ymax + p)
        codes.append(F.when(finite & out, F.lit("outside_site")))
    return F.array_compact(F.array(*codes))


def features_in_windows(features: DataFrame, windows: DataFrame) -> DataFrame:
    """Every feature with the sorted list of windows it intersects."""
    boxed = P.with_box(features)
    two = P.box_join(boxed, windows, ["site_id"], box=256)
    two = two.where(F.size(S.clip(F.col("spans"), F.col("o_r0"), F.col("o_r1"), F.col("o_k0"), F.col("o_k1"))) > 0)
    return two.groupBy("site_id", "id").agg(F.concat_ws(",", F.array_sort(F.collect_set(F.format_string("W%02d", "o_window_id")))).alias("windows"))
