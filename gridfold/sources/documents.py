"""Nested JSON and CSV inputs: drafts, review decisions, score reports, site manifests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.functions import measures as M

POLY = "array<array<int>>"
DRAFT = f"struct<created:string,windows:map<string,array<struct<poly:{POLY},confidence:string,note:string,ignore:boolean>>>>"
DECISIONS = (f"struct<reviewer:string,review_date:string,windows:map<string,struct<decisions:map<string,string>,"
             f"edits:map<string,struct<poly:{POLY},reason:string>>,added_ignore_regions:array<struct<poly:{POLY},note:string>>>>>")
CUT_DECISIONS = "cut_id string, proposed_status string, reason string"


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.col("_metadata.file_name").alias("file"), F.from_json("value", schema).alias("d"))


def _ring(poly: Column, left: Column, top: Column, res: Column) -> Column:
    """Pixel vertices (col, row) to a closed map ring."""
    pts = F.transform(poly, lambda p: M.pixel_to_map(p[0], p[1], left, top, res))
    return M.orient_rings(F.array(F.concat(pts, F.slice(pts, 1, 1))))


def read_drafts(spark: SparkSession, path: str, windows: DataFrame, prefix: str) -> DataFrame:
    """Draft polygons per window to labels ``prefix-NN`` numbered inside their window;
    ``windows`` gives ``window, left, top, res``."""
    d = _documents(spark, path, DRAFT).select("file", "d.created", F.explode("d.windows").alias("window", "polys"))
    rows = d.select("file", "created", "window", F.posexplode("polys").alias("i", "p")).join(windows, "window")
    return rows.select("file", "window", F.concat("window", F.lit("-"), F.format_string(prefix + "-%02d", F.col("i") + 1)).alias("label_id"), "p.confidence", "p.note",
                       F.coalesce("p.ignore", F.lit(False)).alias("ignore"), _ring(F.col("p.poly"), F.col("left"), F.col("top"), F.col("res")).alias("rings"))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decision document to rows ``window, item, kind, value``: decisions, edits, added regions."""
    d = _documents(spark, path, DECISIONS).select("d.reviewer", F.explode("d.windows").alias("window", "w"))
    a = d.select("reviewer", "window", F.explode("w.decisions").alias("item", "value")).withColumn("kind", F.lit("decision"))
    b = d.select("reviewer", "window", F.explode("w.edits").alias("item", "e")).select("reviewer", "window", "item", F.col("e.reason").alias("value"), F.lit("edit").alias("kind"))
    c = d.select("reviewer", "window", F.posexplode("w.added_ignore_regions").alias("i", "r")).select(
        "reviewer", "window", F.format_string("IR%d", F.col("i") + 1).alias("item"), F.col("r.note").alias("value"), F.lit("added_ignore_region").alias("kind"))
    return a.unionByName(b).unionByName(c)


def read_cut_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=CUT_DECISIONS, enforceSchema=False)


def score_table(reports: DataFrame, keep: list[str]) -> DataFrame:
    """Nested score reports (``site_id, report``) to long rows ``site_id, window, metric, value``."""
    body = "struct<" + ",".join(f"{k}:double" for k in keep) + ">"
    r = reports.select("site_id", F.from_json("report", f"struct<overall:{body},per_window:map<string,{body}>>").alias("r"))
    both = r.select("site_id", F.explode(F.map_concat(F.create_map(F.lit("overall"), F.col("r.overall")), F.col("r.per_window"))).alias("window", "m"))
    return both.select("site_id", "window", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"m.{k}").alias("value")) for k in keep])))


def site_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Discovered manifests with ``duplicate``: the site id occurs in several files.

    A line may carry the name of its manifest in ``file``; without it the file that holds the line counts.
    """
    m = spark.read.option("recursiveFileLookup", "true").schema("site_id string, name string, file string").json(path)
    m = m.select("site_id", "name", F.coalesce("file", F.col("_metadata.file_path")).alias("file"))
    dup = m.groupBy("site_id").agg(F.count("*").alias("files"))
    return m.join(dup, "site_id").withColumn("duplicate", F.col("files") > 1)
