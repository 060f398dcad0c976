"""Parcel proposals from boundary lines, their evidence and diagnostics.

Lines are snapped to the edges of a grid (exact for grid-aligned lines), so faces are the cell
regions that no wall edge separates.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold import settings as T
from gridfold.operators import spans as S
from gridfold.operators.chains import ordered_lines
from gridfold.operators.components import cell_components
from gridfold.session import cut, dealt

EVIDENCE_GEOMETRY = {"boundary_segment": ["LineString", "MultiLineString"], "survey_observation": ["Point", "LineString", "MultiLineString"],
                     "reference_parcel": ["Polygon", "MultiPolygon"], "excluded_area": ["Polygon", "MultiPolygon"], "survey_extent": ["Polygon"]}


def wall_edges(lines: DataFrame, keys: list[str], res: float) -> DataFrame:
    """Unit grid edges of snapped lines: ``keys, line_id, x, y, across`` (lower-left end; across
    = horizontal).  A sloping step becomes a horizontal and a vertical edge."""
    n = F.greatest(F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / res - 1e-6), F.lit(1)).cast("int")

    def at(i):
        return F.struct(F.round((F.col("x1") + (F.col("x2") - F.col("x1")) * i / n) / res).cast("int").alias("x"),
                        F.round((F.col("y1") + (F.col("y2") - F.col("y1")) * i / n) / res).cast("int").alias("y"))

    steps = lines.select(*keys, "line_id", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(at(i - 1).alias("p"), at(i).alias("q")))).alias("s"))
    p, q = F.col("s.p"), F.col("s.q")
    flat = F.when(p.x != q.x, F.struct(F.least(p.x, q.x).alias("x"), p.y.alias("y"), F.lit(True).alias("across")))
    up = F.when(p.y != q.y, F.struct(q.x.alias("x"), F.least(p.y, q.y).alias("y"), F.lit(False).alias("across")))
    return steps.select(*keys, "line_id", F.explode(F.array_compact(F.array(flat, up))).alias("e")).select(*keys, "line_id", "e.*").distinct()


def faces(walls: DataFrame, extent: DataFrame, keys: list[str], tile: int = 128) -> DataFrame:
    """Cells of closed faces: ``keys, row, col, face``.  ``extent`` gives ``r0, r1, c0, c1`` cells per
    key; the region that touches a cell beyond it is outside."""
    cells = (extent.withColumn("row", F.explode(F.sequence(F.col("r0") - 1, F.col("r1"))))
             .withColumn("col", F.explode(F.sequence(F.col("c0") - 1, F.col("c1")))).select(*keys, "row", "col", "r0", "c0"))
    one = walls.select(*keys, "x", "y", "across").distinct()
    right = one.where("not across").select(*keys, F.col("y").alias("row"), (F.col("x") - 1).alias("col"), F.lit(True).alias("wc"))
    above = one.where("across").select(*keys, (F.col("y") - 1).alias("row"), F.col("x").alias("col"), F.lit(True).alias("wr"))
    shut = cells.join(right, [*keys, "row", "col"], "left").join(above, [*keys, "row", "col"], "left").select(
        *keys, "row", "col", F.col("wc").isNotNull().alias("wall_c"), F.col("wr").isNotNull().alias("wall_r"))
    comp = cut(cell_components(shut, keys, tile, walls=True))
    outside = extent.select(*keys, (F.col("r0") - 1).alias("row"), (F.col("c0") - 1).alias("col")).join(comp, [*keys, "row", "col"]).select(*keys, "component")
    return comp.join(outside, [*keys, "component"], "left_anti").withColumnRenamed("component", "face")


def wall_sides(walls: DataFrame, face_cells: DataFrame, keys: list[str]) -> DataFrame:
    """Each wall edge with the faces on both sides (NULL = outside)."""
    w = walls.withColumn("ra", F.when(F.col("across"), F.col("y") - 1).otherwise(F.col("y"))).withColumn("ca", F.when(F.col("across"), F.col("x")).otherwise(F.col("x") - 1))
    a = face_cells.select(*keys, F.col("row").alias("ra"), F.col("col").alias("ca"), F.col("face").alias("face_a"))
    b = face_cells.select(*keys, F.col("row").alias("y"), F.col("col").alias("x"), F.col("face").alias("face_b"))
    return w.join(a, [*keys, "ra", "ca"], "left").join(b, [*keys, "y", "x"], "left").drop("ra", "ca")


def unresolved_length(sides: DataFrame, keys: list[str], res: float) -> DataFrame:
    """Length of linework that bounds nothing, by kind: ``keys, cuts_m, dangles_m, unresolved_m``."""
    size = lambda kind: F.round(F.count_if(F.col("kind") == kind) * res, 3)
    return loose_lines(sides, keys).groupBy(*keys).agg(size("cut").alias("cuts_m"), size("dangle").alias("dangles_m"), F.round(F.count("*") * res, 3).alias("unresolved_m"))


def loose_lines(sides: DataFrame, keys: list[str]) -> DataFrame:
    """Wall edges that bound nothing (``keys, x, y, across, kind``): ``dangle`` where pruning open ends again and
    again removes them, ``cut`` where they join what bounds faces.

    Whole lines between branchings go at a time (``ordered_lines``), so the rounds follow the depth of
    branching, not the length of a line.
    """
    flat = sides.select(*keys, "x", "y", "across", F.col("face_a").eqNullSafe(F.col("face_b")).alias("loose")).groupBy(*keys, "x", "y", "across").agg(F.bool_and("loose").alias("loose"))
    code = lambda x, y: y.cast("long") * (1 << 31) + x
    ends = F.array(code(F.col("x"), F.col("y")), F.when(F.col("across"), code(F.col("x") + 1, F.col("y"))).otherwise(code(F.col("x"), F.col("y") + 1)))
    flat = cut(flat.withColumn("ends", ends))
    held = flat.where("not loose").select(*keys, F.explode("ends").alias("node")).distinct().withColumn("held", F.lit(True))
    left = flat.where("loose").select(*keys, "x", "y", "across", F.col("ends")[0].alias("u"), F.col("ends")[1].alias("v"))
    for end in ("u", "v"):  # where an end is held by a boundary the line stops: each edge gets an end of its own there
        left = left.join(held.withColumnRenamed("node", end), [*keys, end], "left").withColumnRenamed("held", f"held_{end}")
    own = lambda k: -(code(F.col("x"), F.col("y")) * 4 + F.col("across").cast("long") * 2 + k + 1)
    left = cut(left.select(*keys, "x", "y", "across", F.when(F.col("held_u"), own(0)).otherwise(F.col("u")).alias("u"), F.when(F.col("held_v"), own(1)).otherwise(F.col("v")).alias("v")))
    gone = None
    while True:
        lines = ordered_lines(left.select(*keys, "u", "v"), keys)
        deg = left.select(*keys, F.explode(F.array("u", "v")).alias("node")).groupBy(*keys, "node").agg(F.count("*").alias("d")).where("d = 1 and node >= 0").select(*keys, "node")
        start = lines.where("pos = 0").select(*keys, "first", "second", F.col("first").alias("node"))
        stop = lines.where("pos = edges - 1").select(*keys, "first", "second", F.col("v").alias("node"))
        open_ = start.unionByName(stop).join(deg, [*keys, "node"]).select(*keys, "first", "second").distinct()
        marked = lines.join(open_, [*keys, "first", "second"], "left_semi").select(*keys, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        marked = cut(left.withColumn("a", F.least("u", "v")).withColumn("b", F.greatest("u", "v")).join(marked, [*keys, "a", "b"], "left_semi").drop("a", "b"))
        if marked.isEmpty():
            cuts = left.withColumn("kind", F.lit("cut"))
            out = cuts if gone is None else gone.withColumn("kind", F.lit("dangle")).unionByName(cuts)
            return out.select(*keys, "x", "y", "across", "kind")
        gone = marked if gone is None else gone.unionByName(marked)
        left = cut(left.join(marked.select(*keys, "u", "v"), [*keys, "u", "v"], "left_anti"))


def propose_parcels(face_cells: DataFrame, survey: DataFrame, exclusions: DataFrame, existing: DataFrame, keys: list[str], res: float,
                    tiny: float = 0.01, tol: float = 0.01) -> DataFrame:
    """Every face with what becomes of it: ``keys, face, cells, decision, existing_id``.

    ``decision`` is the first that holds: ``tiny`` (area at most ``tiny`` m2), ``outside_survey_extent``,
    ``excluded_area_intersection``, ``equal_to_existing``, ``existing_parcel_overlap`` (the last three by more, or
    no more, than ``tol`` m2); else ``proposed``.  ``survey`` and ``exclusions`` are cells (``keys, row, col``; no survey rows of a
    key: no limit there), ``existing`` cells with ``parcel_id``.  ``existing_id`` is the equal parcel, or else the smallest overlapping one.
    """
    at = [*keys, "row", "col"]
    zones = survey.select(*at).distinct().withColumn("_in", F.lit(1)), exclusions.select(*at).distinct().withColumn("_bad", F.lit(1))
    limited = survey.select(*keys).distinct().withColumn("_limited", F.lit(True))
    own = face_cells.join(zones[0], at, "left").join(zones[1], at, "left").groupBy(*keys, "face").agg(F.count("*").alias("cells"), F.count("_in").alias("inside"), F.count("_bad").alias("banned"))
    sizes = existing.groupBy(*keys, "parcel_id").agg(F.count("*").alias("size"))
    met = face_cells.join(existing.select(*at, "parcel_id"), at).groupBy(*keys, "face", "parcel_id").agg(F.count("*").alias("shared"))
    met = met.join(sizes, [*keys, "parcel_id"]).join(own.select(*keys, "face", "cells"), [*keys, "face"])
    cell = res * res
    equal = (F.col("cells") + F.col("size") - 2 * F.col("shared")) * cell <= tol
    met = met.groupBy(*keys, "face").agg(F.min(F.when(equal, F.col("parcel_id"))).alias("same"), F.min(F.when(F.col("shared") * cell > tol, F.col("parcel_id"))).alias("over"))
    all_ = own.join(limited, keys, "left").join(met, [*keys, "face"], "left")
    decision = (F.when(F.col("cells") * cell <= tiny, "tiny").when(F.col("_limited") & (F.col("inside") < F.col("cells")), "outside_survey_extent")
                .when(F.col("banned") * cell > tol, "excluded_area_intersection").when(F.col("same").isNotNull(), "equal_to_existing")
                .when(F.col("over").isNotNull(), "existing_parcel_overlap").otherwise("proposed"))
    known = F.when(decision == "equal_to_existing", F.col("same")).when(decision == "existing_parcel_overlap", F.col("over"))
    return all_.select(*keys, "face", "cells", decision.alias("decision"), known.alias("existing_id"))


def face_support(sides: DataFrame, keys: list[str], res: float) -> DataFrame:
    """Number of lines on each face's boundary and the boundary length they cover:
    ``keys, face, lines, boundary_m`` (``face_lines`` lists them)."""
    on = face_lines(sides, keys)
    return on.groupBy(*keys, "face").agg(F.count_distinct("line_id").alias("lines"), (F.count_distinct("x", "y", "across") * res).alias("boundary_m"))


def face_lines(sides: DataFrame, keys: list[str]) -> DataFrame:
    """Wall edges that bound a face, with their line: ``keys, face, line_id, x, y, across``."""
    return sides.where(~F.col("face_a").eqNullSafe(F.col("face_b"))).select(
        *keys, "line_id", "x", "y", "across", F.explode(F.array_compact(F.array("face_a", "face_b"))).alias("face"))


def compare_faces(face_cells: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Faces against reference parcels (``keys, ref_id, row, col`` cells): shared cells, IoU, share."""
    fa = face_cells.groupBy(*keys, "face").agg(F.count("*").alias("face_cells"))
    ra = reference.groupBy(*keys, "ref_id").agg(F.count("*").alias("ref_cells"))
    both = face_cells.join(reference, [*keys, "row", "col"]).groupBy(*keys, "face", "ref_id").agg(F.count("*").alias("shared"))
    out = both.join(fa, [*keys, "face"]).join(ra, [*keys, "ref_id"])
    return out.withColumn("iou", F.col("shared") / (F.col("face_cells") + F.col("ref_cells") - F.col("shared"))).withColumn("reference_fraction", F.col("shared") / F.col("ref_cells"))


def parcel_conflicts(parcels: DataFrame, extent: DataFrame, exclusions: DataFrame, keys: list[str], min_cells: float) -> DataFrame:
    """Parcels outside the declared extent or on excluded areas: ``keys, id, conflict``.
    ``parcels``: ``keys, id, spans, cells``; the zones are span tables (``keys, row, c0, c1``)."""
    ids = [*keys, "id"]
    inside = S.covered_cells(parcels, extent, keys, ids).withColumnRenamed("covered", "inside")
    banned = S.covered_cells(parcels, exclusions, keys, ids).withColumnRenamed("covered", "banned")
    both = parcels.select(*ids, "cells").join(dealt(inside), ids, "left").join(dealt(banned), ids, "left").na.fill(0, ["inside", "banned"])
    codes = F.array_compact(F.array(F.when(F.col("inside") < F.col("cells"), F.lit("outside_survey_extent")),
                                    F.when(F.col("banned") > min_cells, F.lit("excluded_area_intersection"))))
    return both.select(*ids, F.explode(codes).alias("conflict"))


def uncovered_cells(extent: DataFrame, parcels: DataFrame, exclusions: DataFrame, keys: list[str]) -> DataFrame:
    """Declared extent that no parcel and no exclusion covers (all span tables)."""
    free = S.bit_rows({"e": extent, "p": parcels.select(*keys, "row", "c0", "c1").unionByName(exclusions.select(*keys, "row", "c0", "c1"))}, keys)
    return free.where("e & ~p <> 0").groupBy(*keys).agg(F.sum(F.bit_count(F.expr("e & ~p")).cast("long")).alias("uncovered_cells"))


def eligible_observations(observations: DataFrame, parcels: DataFrame, keys: list[str]) -> DataFrame:
    """Observations that may support a field check: same parcel and geometry hash, reviewed,
    GNSS or ETS, accuracy at most half a metre."""
    ok = observations.where(F.col("reviewed") & F.col("method").isin("gnss", "ets") & (F.col("accuracy_m") <= T.FIELD_TOL))
    return ok.join(parcels.select(*keys, "parcel_id", "geometry_sha256"), [*keys, "parcel_id", "geometry_sha256"])


def kind_errors(kind: Column, geometry_type: Column) -> Column:
    """Evidence kind against geometry type; NULL when they fit."""
    rule = F.create_map(*[v for k, g in EVIDENCE_GEOMETRY.items() for v in (F.lit(k), F.array(*[F.lit(x) for x in g]))])
    allowed = F.try_element_at(rule, kind)
    return F.when(allowed.isNull(), "unknown_kind").when(~F.array_contains(allowed, geometry_type), "geometry_type")
