"""Feature tables: GeoJSON in, bounding-box columns out, bbox queries and pages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold import settings as T
from gridfold.functions import measures as M
from gridfold.session import pin, scratch

_GEOMETRY = "struct<type:string,coordinates:string>"
FEATURE = f"struct<type:string,id:string,properties:map<string,string>,geometry:{_GEOMETRY}>"


def rings_from_coordinates(kind: Column, coordinates: Column) -> Column:
    """GeoJSON Polygon / MultiPolygon coordinate text to oriented rings."""
    single = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.from_json(coordinates, "array<array<array<array<double>>>>")

    def points(poly):
        return F.transform(poly, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))

    return F.when(kind == "Polygon", M.orient_rings(points(single))).when(
        kind == "MultiPolygon", F.flatten(F.transform(multi, lambda poly: M.orient_rings(points(poly)))))


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """FeatureCollection documents (one per file): ``file, properties, rings``.
    A collection is one JSON value, so a file is one task; large layers come as JSON lines."""
    doc = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    doc = doc.select("file", F.from_json("value", f"struct<type:string,features:array<{FEATURE}>>").alias("d"))
    return _rows(doc.select("file", F.explode("d.features").alias("f")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited GeoJSON features (gz or plain): ``file, properties, rings`` and partition columns."""
    raw = spark.read.text(path)
    rows = raw.select(F.col("_metadata.file_name").alias("file"), *[c for c in raw.columns if c != "value"], F.from_json("value", FEATURE).alias("f"))
    return _rows(rows)


def _rows(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "f"]
    return pin(df, rings=rings_from_coordinates(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))).select(
        *rest, F.col("f.id").alias("geojson_id"), F.col("f.properties").alias("properties"), "rings")


def geojson(rings: Column, properties: Column, fid: Column) -> Column:
    """One feature as GeoJSON text (each ring list is one polygon with holes)."""
    coords = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p.x, p.y)))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), fid.cast("string").alias("id"), properties.alias("properties"),
                              F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry")))


def with_bbox(features: DataFrame) -> DataFrame:
    return pin(features, b=M.bounds(F.col("rings"))).select(*features.columns, "b.*")


def write_features(features: DataFrame, path: str | None = None) -> str:
    """Parquet with flat box columns, ordered in space so row-group statistics prune."""
    path = path or scratch(features.sparkSession, "features")
    out = with_bbox(features).withColumn("_cell", F.floor(F.col("ymin") / 16))
    out.repartitionByRange("site_id", "_cell").sortWithinPartitions("site_id", "_cell", "xmin").drop("_cell").write.parquet(path)
    return path


def bbox_query(features: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Features whose box meets the query box (1e-9 slack for touching edges)."""
    e = T.EPS
    return features.where((F.col("xmin") <= xmax + e) & (F.col("xmax") >= xmin - e) & (F.col("ymin") <= ymax + e) & (F.col("ymax") >= ymin - e))


def page(features: DataFrame, order: str, limit: int, offset: int) -> DataFrame:
    """One page ordered by id (limit clamped to 1..5000) with the matched count on each row."""
    limit, offset = max(1, min(limit, T.PAGE_MAX)), max(0, offset)
    total = features.agg(F.count("*").alias("matched")).withColumn("_j", F.lit(1))
    rows = features.orderBy(order).offset(offset).limit(limit).withColumn("_j", F.lit(1))
    return rows.join(F.broadcast(total), "_j").drop("_j")
