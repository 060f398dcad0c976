"""Road surfaces: thinning, skeleton graph diagnostics, centrelines and their scores."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.functions import measures as M
from gridfold.operators.chains import line_vertices, ordered_lines
from gridfold.operators.components import cell_components
from gridfold.operators.regions import TILE, _schema, with_halo
from gridfold.session import cut

PASSES = 4  # thinning passes per exchange; each pass reads two rings of neighbours


def thin_once(grid: np.ndarray) -> np.ndarray:
    """One pass of the published two-subiteration parallel thinning (Zhang and Suen, 1984)."""
    for second in (False, True):
        n, s = np.roll(grid, 1, 0), np.roll(grid, -1, 0)
        e, w = np.roll(grid, -1, 1), np.roll(grid, 1, 1)
        ne, nw, se, sw = np.roll(n, -1, 1), np.roll(n, 1, 1), np.roll(s, -1, 1), np.roll(s, 1, 1)
        around = [n, ne, e, se, s, sw, w, nw]
        count = sum(a.astype(np.int8) for a in around)
        turns = sum((~a & b).astype(np.int8) for a, b in zip(around, around[1:] + around[:1]))
        side = (~(n & e & w) & ~(n & s & w)) if second else (~(n & e & s) & ~(e & s & w))
        grid = grid & ~(grid & (count >= 2) & (count <= 6) & (turns == 1) & side)
    return grid


def skeleton(mask: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """Thinned mask.  Tiles run several passes on a halo wide enough for them, then exchange;
    the loop ends when no cell changes."""
    reach = 2 * PASSES
    state = cut(mask.select(*keys, "row", "col"))
    schema = _schema(state, [*keys, "row", "col"]) + ", kept boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["_tr"].iloc[0]) * tile - reach - 2, int(pdf["_tc"].iloc[0]) * tile - reach - 2
        grid = np.zeros((tile + 2 * reach + 4,) * 2, bool)
        r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        grid[r, c] = True
        for _ in range(PASSES):
            grid = thin_once(grid)
        own = pdf["_own"].to_numpy()
        return pdf.loc[own, [*keys, "row", "col"]].assign(kept=grid[r, c][own])

    while True:
        out = cut(with_halo(state, tile, reach).groupBy(*keys, "_tr", "_tc").applyInPandas(run, schema))
        if out.where("not kept").isEmpty():
            return state
        state = out.where("kept").drop("kept")


def skeleton_edges(cells: DataFrame, keys: list[str]) -> DataFrame:
    """8-neighbour edges of a skeleton, each once: ``keys, u, v, row, col, row2, col2, length`` in cells."""
    moves = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))])
    here = cells.select(*keys, "row", "col", F.explode(moves).alias("m")).select(
        *keys, "row", "col", (F.col("row") + F.col("m.dr")).alias("row2"), (F.col("col") + F.col("m.dc")).alias("col2"))
    both = here.join(cells.select(*keys, F.col("row").alias("row2"), F.col("col").alias("col2")), [*keys, "row2", "col2"])
    code = lambda r, c: F.col(r).cast("long") * (1 << 31) + F.col(c)
    return both.select(*keys, code("row", "col").alias("u"), code("row2", "col2").alias("v"), "row", "col", "row2", "col2",
                       F.sqrt(F.abs(F.col("row") - F.col("row2")) + F.abs(F.col("col") - F.col("col2"))).alias("length"))


def degrees(cells: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every skeleton pixel with its degree."""
    ends = edges.select(*keys, F.explode(F.array("u", "v")).alias("node")).groupBy(*keys, "node").agg(F.count("*").alias("degree"))
    nodes = cells.select(*keys, (F.col("row").cast("long") * (1 << 31) + F.col("col")).alias("node"))
    return nodes.join(ends, [*keys, "node"], "left").na.fill(0, ["degree"])


def graph_diagnostics(cells: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """Pixels, endpoints, junction pixels and 8-connected components per key."""
    deg = degrees(cells, skeleton_edges(cells, keys), keys).groupBy(*keys).agg(
        F.count("*").alias("pixels"), F.count_if(F.col("degree") == 1).alias("endpoints"), F.count_if(F.col("degree") > 2).alias("junctions"))
    parts = cell_components(cells, keys, tile, eight=True).groupBy(*keys).agg(F.count_distinct("component").alias("components"))
    return deg.join(parts, keys)


def centrelines(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered centrelines of a skeleton, from ``chains.ordered_lines``: chains between pixels of degree
    other than 2, and cycles cut at their smallest pixel.  Lengths are in cells."""
    edges = skeleton_edges(cells, keys).withColumnRenamed("length", "_size").select(*keys, "u", "v", "_size")
    return ordered_lines(edges, keys, "_size")


def centreline_vertices(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, first, second, pos, row, col, along``: the pixels of each centreline in order."""
    at = line_vertices(lines, keys)
    return at.select(*keys, "first", "second", "pos", F.shiftright("node", 31).cast("int").alias("row"), F.expr("cast(node % 2147483648 as int)").alias("col"), "along")


def centreline_scores(reference: DataFrame, prediction: DataFrame, keys: list[str], tol: float, step: float, tile: int = TILE) -> DataFrame:
    """Two road masks compared by their centrelines: ``keys, precision, recall, reference_components,
    prediction_components`` (shares of line length within ``tol`` of the other's lines; null
    where a side has no line; components are 8-connected skeleton parts)."""
    def of(mask):
        cells = skeleton(mask, keys, tile)
        lines = cut(skeleton_edges(cells, keys).select(*keys, *[F.col(a).cast("double").alias(b) for a, b in (("col", "x1"), ("row", "y1"), ("col2", "x2"), ("row2", "y2"))]))
        parts = cell_components(cells, keys, tile, eight=True).groupBy(*keys).agg(F.count_distinct("component").alias("parts"))
        return lines, parts
    (ref, ref_parts), (pred, pred_parts) = of(reference), of(prediction)
    share = lambda a, b, name: line_coverage(a, b, keys, tol, step).select(*keys, F.try_divide("covered", "total").alias(name))
    out = ref_parts.withColumnRenamed("parts", "reference_components").join(pred_parts.withColumnRenamed("parts", "prediction_components"), keys, "full")
    out = out.na.fill(0, ["reference_components", "prediction_components"])
    return out.join(share(pred, ref, "precision"), keys, "left").join(share(ref, pred, "recall"), keys, "left")


def line_coverage(a: DataFrame, b: DataFrame, keys: list[str], tol: float, step: float) -> DataFrame:
    """Length of lines ``a`` and the part of it within ``tol`` of lines ``b`` (``keys, x1, y1, x2,
    y2``): ``keys, total, covered``.  Sample points meet only segments in neighbouring buckets."""
    seg = F.array(F.struct("x1", "y1", "x2", "y2"))
    pts = a.select(*keys, F.explode(M.boundary_samples(seg, step)).alias("p")).select(*keys, F.monotonically_increasing_id().alias("_i"), "p.*")
    pts = cut(pts)
    side = max(tol, step) * 4
    near = pts.withColumn("gx", F.floor(F.col("x") / side)).withColumn("gy", F.floor(F.col("y") / side))
    other = b.select(*keys, F.struct("x1", "y1", "x2", "y2").alias("s"))
    for g, u, v in (("gx", "s.x1", "s.x2"), ("gy", "s.y1", "s.y2")):
        other = other.withColumn(g, F.explode(F.sequence(F.floor((F.least(u, v) - tol) / side), F.floor((F.greatest(u, v) + tol) / side))))
    hit = near.join(other, [*keys, "gx", "gy"]).where(M.point_segment_sq(F.col("x"), F.col("y"), F.col("s")) <= tol * tol + 1e-9)
    covered = hit.select(*keys, "_i", "w").distinct().groupBy(*keys).agg(F.sum("w").alias("covered"))
    total = pts.groupBy(*keys).agg(F.sum("w").alias("total"))
    return total.join(covered, keys, "left").na.fill(0.0, ["covered"])
