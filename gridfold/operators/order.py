"""Numbering, quantiles and next-row lookups that stay parallel when one key is huge."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.session import cut


def number_in_order(df: DataFrame, keys: list[str], order: list, out: str, block: Column, start: int = 1) -> DataFrame:
    """``row_number`` per ``keys`` by ``order`` without one task per key.

    ``block`` must not decrease along the first order column (a date of the timestamp, an id
    divided by a constant): rows are numbered inside (keys, block), block sizes are summed
    over the few blocks, and the two are added.
    """
    df = df.withColumn("_b", block)
    sizes = df.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")
    offsets = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"),
                           before.alias("_before"))
    local = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    match = F.col("_b").eqNullSafe(F.col("_kb"))
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (local.join(offsets, match).withColumn(out, F.col("_before") + F.col("_rn") + (start - 1))
            .drop("_b", "_kb", "_rn", "_before", *[f"_k{i}" for i in range(len(keys))]))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: list[float], pieces: int = 256,
                      limit: int = 1_000_000) -> DataFrame:
    """Linear-interpolated quantiles per key: ``keys, q`` (array, one entry per prob).

    Values are packed with their counts.  A bounded sketch of the distinct values proposes
    cuts, counts per slice find the slice that holds each wanted rank, and slices of more than
    ``limit`` distinct values are cut again, so no task ranks more than that.
    """
    packed = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v"))
              .agg(F.count("*").alias("_c")).withColumn("_g", F.lit(0).cast("long")))
    wants = packed.groupBy(*keys, "_g").agg(F.sum("_c").alias("_n")).withColumn("_p", F.explode(F.array([F.lit(float(p)) for p in probs])))
    wants = wants.withColumn("_at", F.col("_p") * (F.col("_n") - 1)).withColumn("_rank", F.explode(F.array(F.floor("_at"), F.ceil("_at"))))
    wants = wants.select(*keys, "_g", "_p", "_at", "_rank", F.col("_rank").alias("_k"))
    grid = [i / pieces for i in range(1, pieces)]
    while True:
        cuts = packed.groupBy(*keys, "_g").agg(F.array_sort(F.array_distinct(F.approx_percentile("_v", grid, 1000))).alias("_cuts"))
        # slice = number of cut values strictly below the value; kept, as a sketch merged in another order proposes other cuts
        sliced = cut(packed.join(cuts, [*keys, "_g"]).withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts"))
        sizes = sliced.groupBy(*keys, "_g", "_slice").agg(F.sum("_c").alias("_s"), F.count("*").alias("_d"))
        sizes = sizes.withColumn("_below", F.sum("_s").over(Window.partitionBy(*keys, "_g").orderBy("_slice")) - F.col("_s"))
        deeper = (F.col("_g") * (2 * pieces) + F.col("_slice")).alias("_g")
        wants = cut(wants.join(sizes, [*keys, "_g"]).where("_k >= _below and _k < _below + _s").select(
            *keys, deeper, "_p", "_at", "_rank", (F.col("_k") - F.col("_below")).alias("_k"), "_d"))
        packed = sliced.select(*keys, "_v", "_c", deeper).join(wants.select(*keys, "_g").distinct(), [*keys, "_g"], "left_semi")
        small = wants.where(F.col("_d") > limit).isEmpty()
        wants = wants.drop("_d")
        if small:
            break
    ranked = packed.withColumn("_hi", F.sum("_c").over(Window.partitionBy(*keys, "_g").orderBy("_v"))).withColumn("_lo", F.col("_hi") - F.col("_c"))
    got = ranked.join(wants, [*keys, "_g"]).where("_k >= _lo and _k < _hi")
    per = got.groupBy(*keys, "_p", "_at").agg(F.max(F.when(F.col("_rank") == F.floor("_at"), F.col("_v"))).alias("_a"),
                                              F.max(F.when(F.col("_rank") == F.ceil("_at"), F.col("_v"))).alias("_b"))
    per = per.withColumn("_q", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at")))
    picks = [F.max(F.when(F.col("_p") == float(p), F.col("_q"))) for p in probs]
    return per.groupBy(*keys).agg(F.array(*picks).alias("q"))


def next_in_chain(df: DataFrame, keys: list[str], level: str, order: str, block: Column) -> DataFrame:
    """For each row, ``next``: the smallest ``order`` among later rows of the same keys whose
    ``level`` is one higher (NULL if none).

    Two passes: inside a block of the order, then over the first row of each later block, so a
    level that holds most rows is still spread over blocks.
    """
    df = df.withColumn("_b", block)
    probe = df.select(*keys, (F.col(level) + 1).alias("_l"), "_b", F.col(order).alias("_o"), F.lit(None).cast("long").alias("_t"), F.lit(1).alias("_p"))
    target = df.select(*keys, F.col(level).alias("_l"), "_b", F.col(order).alias("_o"), F.col(order).cast("long").alias("_t"), F.lit(0).alias("_p"))
    both = probe.unionByName(target)
    ahead = Window.partitionBy(*keys, "_l", "_b").orderBy(F.desc("_o"), F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    local = both.withColumn("_near", F.min("_t").over(ahead)).where("_p = 1").drop("_t", "_p")
    firsts = both.groupBy(*keys, "_l", "_b").agg(F.min("_t").alias("_first"))
    later = Window.partitionBy(*keys, "_l").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("_far", F.min("_first").over(later)).drop("_first")
    return (local.join(firsts, [*keys, "_l", "_b"])
            .select(*keys, (F.col("_l") - 1).alias(level), F.col("_o").alias(order), F.coalesce("_near", "_far").alias("next")))
