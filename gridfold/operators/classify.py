"""Nearest-centroid attribute classifier with abstention."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_guards(rows: DataFrame, features: list[str]) -> DataFrame:
    """Reasons against fitting, as ``check, passed, detail`` rows."""
    from gridfold.operators.quality import across_splits, violations
    train = rows.where("split = 'train'")
    counts = train.groupBy("use_label").agg(F.count("*").alias("n"))
    few = counts.agg(F.count("*").alias("k")).where("k < 2")
    finite = F.lit(True)
    for f in features:
        finite = finite & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    return violations(block_in_one_split=across_splits(rows, ["site_id", "block_id"]),
                      evidence=train.where("not reviewed or use_label is null or use_label = 'unknown'"),
                      two_classes=few, two_rows_per_class=counts.where("n < 2"), finite_attributes=train.where(~finite))


def fit(rows: DataFrame, features: list[str]) -> DataFrame:
    """Class centres of z-scored train rows: ``use_label, n, center, mean, scale``.

    One grouped pass gives count, mean and variance per class; the overall moments come from those
    (variance within plus variance between), so the train set is read once and large means do not
    cancel.  Scale is the population deviation, 1 when below 1e-6.  One row per class.
    """
    train = rows.where("split = 'train'")
    per = train.groupBy("use_label").agg(F.count("*").alias("n"), F.array(*[F.avg(f) for f in features]).alias("m"), F.array(*[F.var_pop(f) for f in features]).alias("v"))
    n, places = F.sum("n"), range(len(features))
    mean = per.agg(F.array(*[F.sum(F.col("n") * F.col("m")[i]) / n for i in places]).alias("mean")).withColumn("_j", F.lit(1))
    both = per.withColumn("_j", F.lit(1)).join(F.broadcast(mean), "_j")
    off = lambda i: F.col("m")[i] - F.col("mean")[i]
    spread = F.array(*[F.sqrt(F.sum(F.col("n") * (F.col("v")[i] + off(i) * off(i))) / n) for i in places])
    total = both.agg(F.transform(spread, lambda s: F.when(s < 1e-6, 1.0).otherwise(s)).alias("scale")).withColumn("_j", F.lit(1))
    both = both.join(F.broadcast(total), "_j")
    return both.select("use_label", "n", F.zip_with(F.zip_with("m", "mean", lambda a, b: a - b), "scale", lambda a, s: a / s).alias("center"), "mean", "scale")


def two_nearest(rows: DataFrame, model: DataFrame, features: list[str], at_once: int = 10_000) -> DataFrame:
    """Rows plus ``missing`` (an attribute is) and ``nearest``: the two nearest classes as (d, label).

    The model is sent to the tasks in blocks of about ``at_once`` centres, however many there are;
    each block updates the two best so far.
    """
    blocks = max(1, -(-model.count() // at_once))
    packed = model.withColumn("_block", F.pmod(F.xxhash64("use_label"), F.lit(blocks))).groupBy("_block").agg(
        F.collect_list(F.struct("use_label", "center")).alias("_centers"), F.first("mean").alias("_mean"), F.first("scale").alias("_scale"))
    x = F.array(*[F.col(f).cast("double") for f in features])
    missing = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    out = rows.withColumn("_x", x).withColumn("missing", missing).withColumn("nearest", F.array().cast("array<struct<d:double,label:string>>"))
    z = F.zip_with(F.zip_with("_x", "_mean", lambda a, m: a - m), "_scale", lambda a, s: a / s)

    def dist(c) -> Column:
        return F.sqrt(F.aggregate(F.zip_with("_z", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))

    for k in range(blocks):
        one = packed.where(F.col("_block") == k).drop("_block").withColumn("_j", F.lit(1))
        out = out.withColumn("_j", F.lit(1)).join(F.broadcast(one), "_j", "left").withColumn("_z", z)
        here = F.coalesce(F.transform("_centers", lambda c: F.struct(dist(c.center).alias("d"), c.use_label.alias("label"))), F.array().cast("array<struct<d:double,label:string>>"))
        out = out.withColumn("nearest", F.slice(F.array_sort(F.concat("nearest", here)), 1, 2)).drop("_j", "_z", "_centers", "_mean", "_scale")
    return out.drop("_x")


def predict(rows: DataFrame, model: DataFrame, features: list[str], max_distance: float = 3.0, margin: float = 0.1) -> DataFrame:
    """Suggestion per row: nearest centre, or unknown when an attribute is missing, the nearest
    centre is farther than ``max_distance``, or the two nearest differ by less than ``margin``."""
    ranked = two_nearest(rows, model, features)
    first, second = F.try_element_at("nearest", F.lit(1)), F.try_element_at("nearest", F.lit(2))
    vague = F.coalesce(second.d - first.d < margin, F.lit(False))
    label = F.when(F.col("missing"), "unknown").when((first.d <= max_distance) & ~vague, first.label).otherwise("unknown")
    reason = F.when(F.col("missing"), "missing attributes").when(label != "unknown", "candidate requires evidence review").otherwise("outside training support or ambiguous")
    return ranked.withColumn("suggestion", label).withColumn("reason", reason).withColumn("distance", F.when(~F.col("missing"), first.d)).drop("missing", "nearest")


def best_epoch(metrics: DataFrame, keys: list[str], score: str) -> DataFrame:
    """First epoch with the largest score."""
    return metrics.groupBy(*keys).agg(F.max(F.struct(F.col(score), (-F.col("epoch")).alias("neg"))).alias("m")).select(
        *keys, (-F.col("m.neg")).alias("epoch"), F.col(f"m.{score}").alias(score))


def better_method(scores: DataFrame, base: str) -> DataFrame:
    """Decision against a base method: recall higher, pixel IoU at least base - 0.02 and recall
    gained in more than one window.  ``scores``: ``method, window_id (NULL = overall), recall, iou``."""
    b = scores.where(F.col("method") == base).select("site_id", F.coalesce("window_id", F.lit(-1)).alias("w"), F.col("recall").alias("b_recall"), F.col("iou").alias("b_iou"))
    m = scores.where(F.col("method") != base).withColumn("w", F.coalesce("window_id", F.lit(-1))).join(b, ["site_id", "w"])
    gain = F.col("recall") > F.col("b_recall")
    out = m.groupBy("site_id", "method").agg(F.count_if(gain & (F.col("w") >= 0)).alias("windows_gained"),
                                             F.bool_or((F.col("w") < 0) & gain).alias("recall_up"),
                                             F.bool_or((F.col("w") < 0) & (F.col("iou") >= F.col("b_iou") - 0.02)).alias("iou_kept"))
    return out.withColumn("better", F.expr("recall_up and iou_kept and windows_gained > 1"))
