"""Structured Streaming twins of the incremental operators; those with keyed state are in
``stateful``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import threats


def firewall_stream(prompts: DataFrame) -> DataFrame:
    """Stateless, with the default lexicon: the batch operators work on a stream as they
    are (append mode)."""
    return threats.firewall_verdict(threats.match_threats(prompts))


def firewall_batches(prompts: DataFrame, patterns: DataFrame, folder: str, checkpoint: str, columns: list[str] | None = None):
    """Verdicts by a table of patterns of any size: the pattern index is built for each
    micro-batch, whose verdicts are written below its batch_id; a batch that runs again
    overwrites its own. A batch in fewer splits than there are cores is spread, since the
    work on prompts stays where they are."""
    def sink(df, batch_id):
        cores = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            df = df.repartition(cores)
        v = threats.firewall_verdict(threats.match_threats(df, patterns))
        (v if columns is None else v.select(*columns)).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return prompts.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EVIDENCE = ["Evidence", "QuantifiedEvidence", "Citation"]


def evidence_windows(feed: DataFrame, ts: str = "ts", late: str = "1 day", size: str = "1 day") -> DataFrame:
    """Event-time variant: node counts per tumbling window; state of windows older
    than the watermark is dropped. In append mode a window comes once, when it is closed,
    in update mode whenever it has changed."""
    n = feed.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)  # watermarks need a zoned type
    return n.groupBy(F.window(ts, size).alias("w"), "agent_id", "criterion_id").agg(F.count("*").alias("nodes")).select(
        F.col("w.start").alias("window_start"), "agent_id", "criterion_id", "nodes")


def write_changes(stream: DataFrame, folder: str, checkpoint: str):
    """Runs an update-mode aggregate over what is available now and appends every
    micro-batch's changed keys to a change table; batch_id makes replays harmless."""
    def sink(df, batch_id):
        df.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows of a change table: the newest batch of every key."""
    vals = [c for c in changes.columns if c not in keys and c != "batch_id"]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*vals), "batch_id").alias("x")).select(*keys, "x.*")


def write_append(stream: DataFrame, folder: str, checkpoint: str):
    return stream.writeStream.outputMode("append").format("parquet").option("path", folder).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
