"""Tiles: sliding grids, blending, scoring seam, instance ownership, resampling, class maps."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile_starts(length: Column, tile: int, stride: int) -> Column:
    """Start positions of sliding tiles; the last tile is flush with the end."""
    last = length - tile
    return F.when(last <= 0, F.array(F.lit(0).cast("long"))).otherwise(
        F.array_sort(F.array_distinct(F.array_append(F.sequence(F.lit(0).cast("long"), last - 1, F.lit(stride).cast("long")), last.cast("long")))))


def tile_grid(rasters: DataFrame, keys: list[str], tile: int, overlap: int) -> DataFrame:
    """One row per tile of each raster (``keys, rows, cols``): ``keys, rows, cols, y0, x0``."""
    s = tile - overlap
    out = rasters.withColumn("y0", F.explode(tile_starts(F.col("rows").cast("long"), tile, s)))
    return out.withColumn("x0", F.explode(tile_starts(F.col("cols").cast("long"), tile, s)))


def to_tiles(cells: DataFrame, tiles: DataFrame, keys: list[str], tile: int, overlap: int) -> DataFrame:
    """Cells repeated for every tile that contains them, with the offset inside the tile.

    Tiles are looked up by their start block, so each cell meets only the few that can hold it.
    """
    t = tiles.select(*keys, "y0", "x0", F.floor(F.col("y0") / tile).alias("by"), F.floor(F.col("x0") / tile).alias("bx"))
    c = (cells.withColumn("by", F.explode(F.array(F.floor(F.col("row") / tile), F.floor(F.col("row") / tile) - 1)))
         .withColumn("bx", F.explode(F.array(F.floor(F.col("col") / tile), F.floor(F.col("col") / tile) - 1))))
    both = c.join(t, [*keys, "by", "bx"]).where(f"row >= y0 and row < y0 + {tile} and col >= x0 and col < x0 + {tile}").drop("by", "bx")
    return both.withColumn("dy", F.col("row") - F.col("y0")).withColumn("dx", F.col("col") - F.col("x0"))


def hann(offset: Column, tile: int) -> Column:
    """Hann window value without its zero end points."""
    return 0.5 - 0.5 * F.cos(F.lit(2 * math.pi) * (offset + 1) / (tile + 1))


def blend(scored: DataFrame, keys: list[str], tile: int, score: str = "score") -> DataFrame:
    """Centre-weighted mean of overlapping tile scores per cell."""
    w = hann(F.col("dy"), tile) * hann(F.col("dx"), tile) + 1e-3
    return scored.groupBy(*keys, "row", "col").agg((F.sum(F.col(score) * w) / F.sum(w)).alias(score), F.count("*").alias("tiles"))


def score_tiles(tiled: DataFrame, keys: list[str], tile: int, value: Column,
                scorer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Run a pluggable scorer over packed tiles.  Each row handed to it is one tile with sorted
    ``idx`` (dy * tile + dx) and ``val`` arrays; it returns the same rows with ``out`` arrays."""
    packed = tiled.groupBy(*keys, "y0", "x0").agg(F.array_sort(F.collect_list(F.struct(
        (F.col("dy") * tile + F.col("dx")).cast("int").alias("i"), value.cast("double").alias("v")))).alias("p"))
    packed = packed.select(*keys, "y0", "x0", F.col("p.i").alias("idx"), F.col("p.v").alias("val"))
    head = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in [*keys, "y0", "x0"])
    out = packed.mapInPandas(scorer, head + ", idx array<int>, out array<double>")
    cells = out.select(*keys, "y0", "x0", F.explode(F.arrays_zip("idx", "out")).alias("c"))
    return cells.select(*keys, "y0", "x0", F.floor(F.col("c.idx") / tile).alias("dy"), (F.col("c.idx") % tile).alias("dx"), F.col("c.out").alias("score")).withColumn(
        "row", F.col("y0") + F.col("dy")).withColumn("col", F.col("x0") + F.col("dx"))


def owned_instances(inst: DataFrame, keys: list[str], tile: int, overlap: int, min_score: float) -> DataFrame:
    """Instances whose centroid lies in the core of their tile: half the overlap is cut from
    sides that have a neighbour tile.  ``inst``: ``keys, y0, x0, instance, score, row, col, rows,
    cols``; cells beyond the raster are dropped first."""
    m = overlap // 2
    mid = (inst.where((F.col("score") > min_score) & (F.col("row") < F.col("rows")) & (F.col("col") < F.col("cols")))
           .groupBy(*keys, "y0", "x0", "rows", "cols", "instance", "score").agg(F.avg("row").alias("cy"), F.avg("col").alias("cx"), F.count("*").alias("cells")))

    def low(s):
        return F.col(s) + F.when(F.col(s) > 0, m).otherwise(0)

    def high(s, n):
        return F.col(s) + tile - F.when(F.col(s) + tile < F.col(n), m).otherwise(0)

    return mid.where((F.col("cy") >= low("y0")) & (F.col("cy") < high("y0", "rows")) & (F.col("cx") >= low("x0")) & (F.col("cx") < high("x0", "cols")))


def best_instance(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One instance per cell: highest score, then the later instance."""
    m = cells.groupBy(*keys, "row", "col").agg(F.max(F.struct("score", "instance")).alias("m"))
    return m.select(*keys, "row", "col", "m.instance", "m.score")


def block_mean(cells: DataFrame, keys: list[str], k: int, total: str, n: str) -> DataFrame:
    """Block average of (sum, count) cells over k x k blocks."""
    g = cells.groupBy(*keys, F.floor(F.col("row") / k).alias("row"), F.floor(F.col("col") / k).alias("col"))
    return g.agg(F.sum(total).alias("total"), F.sum(n).alias("n"), F.count("*").alias("cells"))


def nearest(cells: DataFrame, k: int) -> DataFrame:
    """Nearest-neighbour reduction: the centre cell of each k x k block."""
    out = cells.where((F.col("row") % k == k // 2) & (F.col("col") % k == k // 2))
    return out.withColumn("row", F.floor(F.col("row") / k)).withColumn("col", F.floor(F.col("col") / k))


def arg_max_class(probabilities: Column, threshold: float, void: int = 255) -> Column:
    """Index of the largest probability (first on ties), void below the threshold."""
    best = F.array_max(probabilities)
    return F.when(best >= threshold, (F.array_position(probabilities, best) - 1).cast("int")).otherwise(F.lit(void))


def height_above_ground(dsm: DataFrame, dtm: DataFrame, keys: list[str]) -> DataFrame:
    """DSM minus DTM where both are valid and finite."""
    def ok(c):
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return dsm.join(dtm, [*keys, "row", "col"]).where(ok("dsm") & ok("dtm")).withColumn("height", F.col("dsm") - F.col("dtm"))


def scale_height(h: Column) -> Column:
    return F.least(F.greatest(h, F.lit(-5.0)), F.lit(60.0)) / 60


def normalise_tile(values: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Min-max per tile (range at least 1e-6)."""
    lim = values.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    return values.join(lim, keys).withColumn("scaled", (F.col(v) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-6))).drop("_lo", "_hi")
