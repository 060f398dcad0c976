"""Content of web-map tiles: bilinear resampling of a raster table, then level from level."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 256
LEAST = 1e-3
MERCATOR_EDGE = 20037508.342789244  # metres from the middle of the web-mercator square to its edge


def pixel_size(z: int) -> float:
    return 2 * MERCATOR_EDGE / (TILE * 2 ** z)


def _reach(centre: Column, res: Column, ps: float) -> Column:
    """Global pixels whose centres lie within one cell of a cell's centre (null: none)."""
    low, high = F.ceil((centre - res + MERCATOR_EDGE) / ps - 0.5), F.floor((centre + res + MERCATOR_EDGE) / ps - 0.5)
    return F.when(low <= high, F.sequence(low, high))  # a sequence would run downwards otherwise


def base_pixels(cells: DataFrame, keys: list[str], left: Column, top: Column, res: Column, z: int, value: str = "value") -> DataFrame:
    """``keys, gx, gy, value`` at level ``z`` of cells (``row, col``) on a web-mercator grid.

    Every cell gives its bilinear weight to the pixels around its centre; absent cells weigh
    nothing, so a pixel at the rim is the weighted mean of what there is; one that less than
    ``LEAST`` of a cell reaches stays transparent (its weights would be rounding noise).  Cells give partial sums,
    and one shuffle on the pixel ends it; no halo has to be fetched.
    """
    ps = pixel_size(z)
    x, y = left + (F.col("col") + 0.5) * res, (F.col("row") + 0.5) * res - top  # y grows to the south
    d = cells.select(*keys, F.col(value).alias("_v"), x.alias("_x"), y.alias("_y"), res.alias("_r"))
    d = d.withColumn("gx", F.explode(_reach(F.col("_x"), F.col("_r"), ps))).withColumn("gy", F.explode(_reach(F.col("_y"), F.col("_r"), ps)))

    def weight(g, c):
        return 1 - F.abs((F.col(g) + 0.5) * ps - MERCATOR_EDGE - F.col(c)) / F.col("_r")
    d = d.withColumn("_w", weight("gx", "_x") * weight("gy", "_y")).where("_w > 1e-9")
    sums = d.groupBy(*keys, "gx", "gy").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_w"))
    return sums.where(F.col("_w") >= LEAST).select(*keys, "gx", "gy", (F.col("_s") / F.col("_w")).alias("value"))


def coarser(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The next level: mean of the up to four pixels that are there."""
    return pixels.groupBy(*keys, F.shiftright("gx", 1).alias("gx"), F.shiftright("gy", 1).alias("gy")).agg(F.avg("value").alias("value"))


def in_tiles(pixels: DataFrame, keys: list[str], z: int) -> DataFrame:
    """``keys, z, x, y, px, py, value``; pixels outside the zoom grid are left out."""
    most = TILE * 2 ** z
    inside = F.col("gx").between(0, most - 1) & F.col("gy").between(0, most - 1)
    return pixels.where(inside).select(*keys, F.lit(z).alias("z"), F.expr(f"gx div {TILE}").alias("x"), F.expr(f"gy div {TILE}").alias("y"),
                                       (F.col("gx") % TILE).cast("int").alias("px"), (F.col("gy") % TILE).cast("int").alias("py"), "value")


def tile_pyramid(cells: DataFrame, keys: list[str], left: Column, top: Column, res: Column, z: int, levels: int, value: str = "value") -> DataFrame:
    """Levels ``z`` down to ``z - levels + 1``, each from the one below it."""
    if not 0 <= z - levels + 1 <= z <= 24:
        raise ValueError("zoom levels lie between 0 and 24")
    pixels = base_pixels(cells, keys, left, top, res, z, value)
    out = in_tiles(pixels, keys, z)
    for k in range(1, levels):
        pixels = coarser(pixels, keys)
        out = out.unionByName(in_tiles(pixels, keys, z - k))
    return out
