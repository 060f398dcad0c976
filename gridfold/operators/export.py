"""Export gates and manifests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold import settings as T
from gridfold.operators.order import number_in_order


def provenance_error(origin: Column, status: Column, feature_type: Column, class_name: Column) -> Column:
    """First provenance error of a feature, NULL when it may be exported."""
    return (F.when(origin.isNull() | ~origin.isin(T.ORIGINS), "invalid_origin")
            .when(status.isNull() | ~status.isin(T.STATUSES), "invalid_status")
            .when((feature_type == "land_cover") & class_name.isNull(), "class_required"))


def first_errors(rows: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """The listed errors of a refused export: smallest keys first, a top-k report."""
    return rows.where("error is not null").orderBy(key).limit(limit)


def output_errors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Gate of an extraction output: one error code per row or NULL.  ``source_id`` must be a
    positive integer that occurs once per layer."""
    dup = rows.groupBy(*keys, "source_id").agg(F.count("*").alias("_n")).where("_n > 1")
    both = rows.join(dup, [*keys, "source_id"], "left")
    error = (F.when(F.col("source_id").isNull() | (F.col("source_id") < 1) | (F.col("_n") > 1), "source_id")
             .when(F.col("feature_type").isNull() | ~F.col("feature_type").isin(T.FEATURE_TYPES), "feature_type")
             .when(F.coalesce("functional_use", F.lit("unknown")) != "unknown", "functional_use"))
    return both.withColumn("error", error).drop("_n")


def import_candidates(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """External features as a candidate layer: renumbered from 1, source id kept, score kept if
    given, functional use unknown."""
    out = number_in_order(rows, keys, [order], "source_id", F.floor(F.col(order) / 65536))
    return out.withColumn("functional_use", F.lit("unknown")).withColumn("import_source_id", F.col(order).cast("string"))


def manifest(features: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and total area overall and by origin, status, type and source layer, as long rows."""
    dims = ["origin", "review_status", "feature_type", "source_layer"]
    sets = [[*keys]] + [[*keys, d] for d in dims]
    rows = features.groupingSets(sets, *keys, *dims).agg(
        F.count("*").alias("features"), F.sum("area_mm2").alias("area_mm2"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    name = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.lit(d)) for d in dims], F.lit("all"))
    value = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.col(d)) for d in dims], F.lit("all"))
    return rows.select(*keys, name.alias("by"), value.alias("value"), "features", F.round(F.col("area_mm2") / 1e6, 3).alias("area_m2"))
