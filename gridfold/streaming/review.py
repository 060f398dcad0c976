"""Structured Streaming forms of the review operators."""
from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridfold.session import scratch

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(df: DataFrame, mode: str, write, checkpoint: str) -> None:
    q = (df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))


def _batch_writer(path: str):
    """Each micro-batch owns one folder, so a replayed batch replaces itself."""
    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(os.path.join(path, f"batch={batch}-part"))
    return write


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def current_state(spark: SparkSession, log: DataFrame, keys: list[str]) -> DataFrame:
    """T1: latest ``after`` per feature maintained from a streamed log.  Each batch appends the
    features it changed; the newest change row of a feature is its state."""
    path = scratch(spark, "state")
    agg = log.groupBy(*keys).agg(F.max(F.struct("revision", "after")).alias("m"))
    _run(agg, "update", _batch_writer(path), scratch(spark, "ckpt"))
    changes = _read(spark, path)
    return changes.groupBy(*keys).agg(F.max("m").alias("m")).select(*keys, "m.revision", "m.after").where("after is not null")


def review_effort(spark: SparkSession, log: DataFrame) -> DataFrame:
    """T3: running duration and counts by operation per site (updates, newest row wins)."""
    path = scratch(spark, "effort")
    agg = log.groupBy("site_id").agg(F.sum("duration_ms").alias("duration_ms"), F.count("*").alias("events"),
                                     F.count_if(F.col("operation") == "accept").alias("accepts"),
                                     F.count_if(F.col("operation") == "reject").alias("rejects"))
    _run(agg, "update", _batch_writer(path), scratch(spark, "ckpt"))
    return (_read(spark, path).groupBy("site_id")
            .agg(F.max(F.struct("batch", "duration_ms", "events", "accepts", "rejects")).alias("m"))
            .select("site_id", "m.duration_ms", "m.events", "m.accepts", "m.rejects"))


class RevisionGate(StatefulProcessor):
    """State: current revision of one site.  Rows of a batch are folded by arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revision = handle.getValueState("revision", "revision long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        current = self.revision.get()[0] if self.revision.exists() else 0
        batch = pd.concat(list(rows)).sort_values("arrival")
        ok = []
        for want in batch["expected"].tolist():
            ok.append(want == current)
            current += ok[-1]
        self.revision.update((current,))
        yield pd.DataFrame({"site_id": key[0], "arrival": batch["arrival"].to_numpy(), "accepted": ok})

    def close(self) -> None:
        pass


def gated_writes(spark: SparkSession, log: DataFrame) -> DataFrame:
    """T2: accepted / rejected writes of a stream (``site_id, arrival, expected``); across
    batches, arrival order is the contract."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    path = scratch(spark, "gate")
    out = log.groupBy("site_id").transformWithStateInPandas(
        RevisionGate(), "site_id long, arrival long, accepted boolean", "append", "none")
    _run(out, "append", _batch_writer(path), scratch(spark, "ckpt"))
    return _read(spark, path).drop("batch")


def publish_layers(spark: SparkSession, stream: DataFrame, gate, expected: DataFrame) -> DataFrame:
    """T4: publish a layer once all of it has arrived, and only if every row of it passes.

    Batches are staged.  ``expected`` (``layer, rows``) says how many rows a layer has; when a
    layer is complete, ``gate`` maps all its staged rows to rows with ``error``, and a layer
    without errors is written to a new folder.  Each layer is judged once, however its rows were
    spread over batches.
    """
    staged, out = scratch(spark, "staged"), scratch(spark, "published")
    schema = stream.schema

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(os.path.join(staged, f"batch={batch}-part"))
        came = df.select("layer").distinct()
        held = spark.read.schema(schema).parquet(os.path.join(staged, "*")).join(came, "layer", "left_semi")
        full = held.groupBy("layer").agg(F.count("*").alias("rows")).join(expected.select("layer", "rows"), ["layer", "rows"], "left_semi").select("layer")
        whole = held.join(full, "layer", "left_semi").persist()
        bad = gate(whole).where("error is not null").select("layer").distinct()
        whole.join(bad, "layer", "left_anti").write.mode("overwrite").parquet(os.path.join(out, f"batch={batch}-part"))
        whole.unpersist()

    _run(stream, "append", write, scratch(spark, "ckpt"))
    return _read(spark, out)


def stream_of(spark: SparkSession, df: DataFrame, batches: int = 3, files: int = 4) -> DataFrame:
    """Replay a table as a file stream: consecutive ranges of its first column become
    consecutive micro-batches (written one after the other, ``files`` files each)."""
    path, order = scratch(spark, "stream"), df.columns[0]
    cuts = df.approxQuantile(order, [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    bounds = [float("-inf"), *cuts, float("inf")]
    for lo, hi in zip(bounds, bounds[1:]):
        part = df.where((F.col(order) > lo) & (F.col(order) <= hi)) if batches > 1 else df
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)
