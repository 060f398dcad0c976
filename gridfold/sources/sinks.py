"""Sinks: score reports, CSV logs, feature exports (never overwriting) and their manifests."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_report(scores: DataFrame) -> DataFrame:
    """One JSON document per site: overall metrics and a map of per-window metrics.
    A site's windows are a bounded design, so the map holds the windows of one site only."""
    cols = [c for c in scores.columns if c not in ("site_id", "window_id")]
    body = F.struct(*cols)
    per = scores.where("window_id is not null").groupBy("site_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("window_id").cast("string"), body))).alias("per_window"))
    top = scores.where("window_id is null").select("site_id", body.alias("overall"))
    return top.join(per, "site_id").select("site_id", F.to_json(F.struct("overall", "per_window")).alias("report"))


def export_features(features: DataFrame, path: str, zone: int, south: bool) -> None:
    """Reviewed features below a new folder: analysis CRS and WGS84 GeoJSON lines, one folder
    per feature class.  Refuses an existing folder."""
    from gridfold.functions.projection import unproject_rings
    from gridfold.sources.features import geojson
    props = F.struct(*[c for c in features.columns if c not in ("rings", "feature_id")])
    for name, rings in (("analysis", F.col("rings")), ("wgs84", unproject_rings(F.col("rings"), zone, south))):
        lines = features.select("feature_type", geojson(rings, props, F.col("feature_id")).alias("value"))
        lines.write.mode("errorifexists").partitionBy("feature_type").text(f"{path}/{name}")


def export_all_or_nothing(rows: DataFrame, manifest: DataFrame, path: str, zone: int, south: bool) -> DataFrame:
    """``error, n`` of the rows (``error``: code or NULL).  Only if there is none are the features
    written, with ``manifest`` beside them; otherwise nothing is."""
    report = rows.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))
    if report.isEmpty():
        export_features(rows.drop("error"), path, zone, south)
        manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return report


def export_parcels(features: DataFrame, history: DataFrame, path: str, states: list[str]) -> None:
    """Saved parcel revision: one folder per entity kind (parcels only in the wanted states) and
    the history up to that revision."""
    wanted = features.where((F.col("kind") != "parcel") | F.col("parcel_state").isin(states))
    wanted.write.mode("errorifexists").partitionBy("kind").parquet(f"{path}/entities")
    history.write.mode("errorifexists").json(f"{path}/history")


def write_log(rows: DataFrame, path: str) -> None:
    """Diagnosis and review logs as CSV with a header."""
    rows.write.mode("errorifexists").option("header", True).csv(path)
