"""Session defaults and the one place where lineage is cut.

Loops cut lineage with a reliable ``checkpoint()`` into the shared folder that the
cluster names in ``spark.checkpoint.dir``; a lost executor then costs a re-read.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "gridfold", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder: the session's setting, or our own only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table or export written by a job."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def cut(df: DataFrame) -> DataFrame:
    """Materialise once and forget the lineage (survives executor loss, unlike a local cut).  The shuffle files that led
    to it go at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    shared_dir(spark)
    kept = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under that setting
    finally:
        spark.conf.set(CLEANUP, kept)


def spread(df: DataFrame, *by: str, rows: int = 50_000) -> DataFrame:
    """Repartition a stored table whose splits are fewer than the session's cores, or hold more than ``rows``
    rows each on average: what follows makes much of a small row, so a task is bounded by rows, not by bytes.
    Ranges keep near keys together, so that sums of a site or a raster row are formed before a shuffle."""
    need = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))  # counted from the files' footers
    return df.repartitionByRange(need, *by) if df.rdd.getNumPartitions() < need else df


def dealt(df: DataFrame) -> DataFrame:
    """Rows that an ``explode`` or an array column made larger than the planner knows: it takes their size from
    the input file and would collect them on the driver for a broadcast.  A join with them is dealt by key."""
    return df.hint("merge")


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add expensive columns so that each is evaluated exactly once per row.

    A one-row generator stops the optimiser from copying the expressions into pushed-down
    filters and inferred null checks.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def all_of(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
