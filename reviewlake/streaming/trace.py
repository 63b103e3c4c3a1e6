"""Live use of the event log and of the stateless review stages, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_findings(diffs: DataFrame, review: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """A query that reviews each batch of diffs by the batch functions (their windows aren't by time) and writes its findings.

    A batch that runs again after a failure replaces its own output.
    """

    def each(batch: DataFrame, number: int) -> None:
        review(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return diffs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(trace: DataFrame, width: str = "5 minutes", late: str = "10 minutes", time: str = "timestamp", kind: str = "kind") -> DataFrame:
    """Events by kind and window; rows later than the watermark are dropped in a stream. The same plan serves a batch."""
    t = trace.withWatermark(time, late) if trace.isStreaming else trace
    return t.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def dedupe_events(trace: DataFrame, keys: list[str], late: str = "10 minutes", time: str = "timestamp") -> DataFrame:
    """One event for each key: a log that is appended to again repeats its events."""
    if trace.isStreaming:
        return trace.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return trace.dropDuplicates(keys)


def tool_durations(starts: DataFrame, finishes: DataFrame, keys: list[str], most: str = "1 hour", late: str = "10 minutes", time: str = "timestamp") -> DataFrame:
    """keys, started, micros (microseconds) of each start and the finishes within `most` after it: an interval join, by stream or batch."""
    s, f = starts.withColumnRenamed(time, "started"), finishes.withColumnRenamed(time, "finished")
    if starts.isStreaming:
        s, f = s.withWatermark("started", late), f.withWatermark("finished", late)
    s, f = s.select(*keys, "started"), f.select(*[F.col(k).alias(f"_{k}") for k in keys], "finished")
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    j = s.join(f, [*same, F.col("finished") >= F.col("started"), F.col("finished") <= F.col("started") + F.expr(f"INTERVAL {most}")])
    return j.select(*keys, "started", (F.unix_micros(F.col("finished").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))).alias("micros"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def running_ratchet(findings: DataFrame, most: int, path: str, checkpoint: str, suite: str = "suite"):
    """A query that counts a stream's findings by suite and writes, for each batch, the suites it changed: suite, total, exceeded.

    The counts are keyed state in the RocksDB state store, whose changes go to the checkpoint: a query that is started there again goes on
    counting. A batch that runs again after a failure replaces its own output.
    """
    spark = findings.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)  # a query keeps the settings that it began with
    try:
        each = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        totals = ratchet_totals(findings, most, suite).writeStream.outputMode("update")
        return totals.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


def ratchet_totals(findings: DataFrame, most: int, suite: str = "suite") -> DataFrame:
    """Findings by suite, and whether they pass the cap: of a table, or of a stream so far."""
    return findings.groupBy(suite).agg(F.count(F.lit(1)).alias("total")).withColumn("exceeded", F.col("total") > most)
