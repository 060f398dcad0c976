"""Raster tables: cells packed into tiles on disk, unpacked to cells on read."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.session import scratch


def write_tiles(cells: DataFrame, keys: list[str], tile: int, bands: list[str], path: str | None = None) -> str:
    """Tiles with sorted cell offsets and one array per band, partitioned by the first key."""
    path = path or scratch(cells.sparkSession, "tiles")
    packed = cells.groupBy(*keys, F.floor(F.col("row") / tile).alias("tile_r"), F.floor(F.col("col") / tile).alias("tile_c")).agg(
        F.array_sort(F.collect_list(F.struct((F.pmod("row", F.lit(tile)) * tile + F.pmod("col", F.lit(tile))).cast("int").alias("i"), *bands))).alias("p"))
    packed.select(*keys, "tile_r", "tile_c", F.col("p.i").alias("idx"), *[F.col(f"p.{b}").alias(b) for b in bands]).write.partitionBy(keys[0]).parquet(path)
    return path


def read_tiles(spark: SparkSession, path: str, tile: int) -> DataFrame:
    """Cells of a tile table: ``row, col`` and one column per band."""
    t = spark.read.parquet(path)
    bands = [c for c in t.columns if t.schema[c].dataType.typeName() == "array" and c != "idx"]
    rest = [c for c in t.columns if c not in (*bands, "idx", "tile_r", "tile_c")]
    flat = t.select(*rest, "tile_r", "tile_c", F.explode(F.arrays_zip("idx", *bands)).alias("c"))
    return flat.select(*rest, (F.col("tile_r") * tile + F.floor(F.col("c.idx") / tile)).cast("int").alias("row"),
                       (F.col("tile_c") * tile + F.col("c.idx") % tile).cast("int").alias("col"), *[F.col(f"c.{b}").alias(b) for b in bands])
