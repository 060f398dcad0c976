"""Split protocols, leakage checks, hash inventories, label and layer verification."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold import settings as T


def violations(**found: DataFrame) -> DataFrame:
    """One table ``check, passed, detail``: a check passes when its frame of offenders is empty.
    Only counts leave the checks."""
    out = None
    for name, df in found.items():
        row = df.agg(F.count("*").alias("detail")).select(F.lit(name).alias("check"), (F.col("detail") == 0).alias("passed"), "detail")
        out = row if out is None else out.unionByName(row)
    return out


def across_splits(samples: DataFrame, key: list[str]) -> DataFrame:
    """Keys (block, image hash ...) that occur in more than one split."""
    return samples.groupBy(*key).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def repeated(samples: DataFrame, key: list[str]) -> DataFrame:
    return samples.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def missing_splits(samples: DataFrame) -> DataFrame:
    have = samples.agg(F.collect_set("split").alias("s"))
    return have.select(F.explode(F.array_except(F.array(*[F.lit(s) for s in T.SPLITS]), "s")).alias("split"))


def split_leaks(boxes: DataFrame, keys: list[str], buffer: float, inclusive: bool, cell: float) -> DataFrame:
    """Samples of different splits that overlap (area > 1e-6) or lie nearer than ``buffer``
    (``inclusive``: at most ``buffer``): ``keys, a, b, pairs``; a and b are the smallest ids of
    each distinct (box, split).

    Equal boxes of one split are joined once with their count.
    """
    box = ["xmin", "ymin", "xmax", "ymax"]
    one = boxes.groupBy(*keys, "split", *box).agg(F.min("id").alias("id"), F.count("*").alias("n"))

    def bucket(lo, hi, grow):
        return F.sequence(F.floor((F.col(lo) - grow) / cell), F.floor((F.col(hi) + grow) / cell))

    left = one.withColumn("by", F.explode(bucket("ymin", "ymax", buffer))).withColumn("bx", F.explode(bucket("xmin", "xmax", buffer)))
    right = one.withColumn("by", F.explode(bucket("ymin", "ymax", 0))).withColumn("bx", F.explode(bucket("xmin", "xmax", 0)))
    right = right.select(*keys, "by", "bx", *[F.col(c).alias(f"o_{c}") for c in ("id", "split", "n", *box)])
    both = left.join(right, [*keys, "by", "bx"]).where("split < o_split")
    dx = F.greatest(F.lit(0.0), F.col("o_xmin") - F.col("xmax"), F.col("xmin") - F.col("o_xmax"))
    dy = F.greatest(F.lit(0.0), F.col("o_ymin") - F.col("ymax"), F.col("ymin") - F.col("o_ymax"))
    w = F.least("xmax", "o_xmax") - F.greatest("xmin", "o_xmin")
    h = F.least("ymax", "o_ymax") - F.greatest("ymin", "o_ymin")
    overlap = (w > 0) & (h > 0) & (w * h > 1e-6)
    d2 = dx * dx + dy * dy
    near = (d2 <= buffer * buffer) if inclusive else (F.lit(buffer > 0) & (d2 < buffer * buffer))
    # a pair is kept in the bucket of its reference corner only
    owner = ((F.col("by") == F.floor(F.greatest(F.col("ymin") - buffer, F.col("o_ymin")) / cell))
             & (F.col("bx") == F.floor(F.greatest(F.col("xmin") - buffer, F.col("o_xmin")) / cell)))
    return both.where(owner & (overlap | near)).select(*keys, F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b"), (F.col("n") * F.col("o_n")).alias("pairs"))


def manifest_protocol(samples: DataFrame, leaks: DataFrame) -> DataFrame:
    """Split protocol of tile samples, one row per rule."""
    return violations(
        unique_ids=repeated(samples, ["id"]), all_splits_present=missing_splits(samples),
        known_splits=samples.where(~F.col("split").isin(T.SPLITS)), labels_reviewed=samples.where(~F.col("reviewed")),
        evaluation_locked=samples.where((F.col("split") == "evaluation") & ~F.col("labels_locked")),
        block_in_one_split=across_splits(samples, ["site_id", "block_id"]), image_in_one_split=across_splits(samples, ["image_sha"]),
        spatial_separation=leaks)


def use_protocol(rows: DataFrame, leaks: DataFrame, classes: list[str], attributes: list[str]) -> DataFrame:
    """Protocol of use samples: ids, blocks, evidence, labels, numbers, spatial buffer."""
    bad_number = F.lit(False)
    missing = F.lit(False)
    for a in attributes:
        bad_number = bad_number | F.coalesce(F.isnan(F.col(a).cast("double")) | (F.col(a) < 0), F.lit(False))
        missing = missing | F.col(a).isNull()
    train = F.col("split") == "train"
    return violations(
        unique_ids=repeated(rows, ["site_id", "id"]), all_splits_present=missing_splits(rows),
        block_in_one_split=across_splits(rows, ["site_id", "block_id"]), geometry_in_one_split=across_splits(rows, ["geometry_sha"]),
        reviewed_with_evidence=rows.where(~F.col("reviewed") | (F.size("evidence") == 0)),
        declared_labels=rows.where(~F.col("use_label").isin([*classes, "unknown"]) | (train & (F.col("use_label") == "unknown"))),
        finite_attributes=rows.where(bad_number), train_attributes=rows.where(train & missing), spatial_separation=leaks)


def hash_inventory(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Compare ``path, sha256`` lists: checked, changed, missing, unlisted."""
    both = expected.select("path", F.col("sha256").alias("want")).join(actual.select("path", F.col("sha256").alias("have")), "path", "full")
    status = (F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted")
              .when(F.col("want") == F.col("have"), "checked").otherwise("changed"))
    return both.select("path", status.alias("status"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below a folder, hashed where it is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("path"), F.sha2("content", 256).alias("sha256"))


def full_coverage(records: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """Problems of a decision list that must cover an inventory exactly once."""
    r = records.groupBy(key).agg(F.count("*").alias("n"))
    both = r.join(inventory.select(key).distinct().withColumn("listed", F.lit(True)), key, "full")
    problem = F.when(F.col("n").isNull(), "undecided").when(F.col("listed").isNull(), "unknown_id").when(F.col("n") > 1, "repeated")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def same_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in only one of two key sets, tagged with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def raster_flags(crs: Column, bands: Column, dtype: Column, bounds: Column, pixels: Column, licence: Column) -> Column:
    """Metadata gate of a raster: codes of everything that is wrong or unverified."""
    ok = (bounds.xmin >= -180) & (bounds.xmin < bounds.xmax) & (bounds.xmax <= 180) & (bounds.ymin > -85) & (bounds.ymin < bounds.ymax) & (bounds.ymax < 85)
    return F.array_compact(F.array(
        F.when(F.coalesce(crs, F.lit("")) == "", F.lit("not_georeferenced")), F.when((bands < 3) | (dtype != "uint8"), F.lit("needs_rgb_uint8")),
        F.when(~F.coalesce(ok, F.lit(False)), F.lit("bounds")), F.when(pixels <= 0, F.lit("empty")),
        F.when(F.lower(F.trim(F.coalesce(licence, F.lit("")))).isin("", "unknown"), F.lit("source_licence_unverified"))))


def elevation_flags(kind: str, bands: Column, bounds: Column, image_bounds: Column, grid: Column, image_grid: Column) -> Column:
    """Gate of an elevation raster (``dsm`` or ``dtm``) beside its image: refused if it has other
    than one band or does not cover the image; flagged where its grid (any comparable struct of
    reference system, transform and size) differs; vertical units are never verified.  No raster
    (null bounds): no flags."""
    covers = (bounds.xmin <= image_bounds.xmin) & (bounds.ymin <= image_bounds.ymin) & (bounds.xmax >= image_bounds.xmax) & (bounds.ymax >= image_bounds.ymax)
    flags = F.array_compact(F.array(
        F.when(F.coalesce(bands, F.lit(0)) != 1, F.lit(f"{kind}_not_single_band")), F.when(~F.coalesce(covers, F.lit(False)), F.lit(f"{kind}_does_not_cover_imagery")),
        F.when(~grid.eqNullSafe(image_grid), F.lit(f"{kind}_requires_explicit_alignment")), F.lit(f"{kind}_vertical_units_unverified")))
    return F.when(bounds.isNull(), F.array().cast("array<string>")).otherwise(flags)


def frozen_chain(recorded: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded against actual hashes of protocol, dataset and model: mismatches per key."""
    both = recorded.join(actual.withColumnRenamed("sha256", "have"), [*keys, "item"], "left")
    bad = F.col("have").isNull() | (F.col("have") != F.col("sha256"))
    return both.groupBy(*keys).agg(F.count_if(bad).alias("mismatches"), (F.count_if(bad) == 0).alias("passed"))
