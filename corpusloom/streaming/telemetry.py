"""Telemetry over a stream: events appended once each, the latest ones held as state, and aggregates by window (an extension)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.utils import AnalysisException

#: Events that are held, and shards of the state: the latest of all are among the latest of each.
LATEST, SHARDS = 100, 8
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: The store that keeps state of this kind.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, requests, latency) by window; events later than the watermark are left out. For streams and tables."""
    grouped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", width), "event_type")
    counts = grouped.agg(F.count(F.lit(1)).alias("requests"), F.sum("value").alias("latency"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "requests", "latency")


def read_events(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """A stream of the parquet files of a folder that match events*.parquet, at most so many of them at once."""
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet")
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def append_batch(rows: DataFrame, batch: int, table: str) -> None:
    """Writes a batch as the partition of its number: the same batch again replaces itself, so each event is there once however often a batch is tried."""
    rows.write.mode("overwrite").parquet(f"{table}/batch={batch}")


def appended(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The events of a table that append_batch has written; none before the first batch."""
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(table)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch long")


class _Latest(StatefulProcessor):
    """Of each shard the latest events, by time and number; every batch gives them anew."""

    def __init__(self, n: int) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("latest", "ts timestamp, event_id long, latency_ms double, status int, tokens int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        columns = ["ts", "event_id", "latency_ms", "status", "tokens"]
        before = pd.DataFrame([tuple(r) for r in self.held.get()] if self.held.exists() else [], columns=columns)
        for more in rows:  # a batch's rows come in parts; what can't be among the latest goes at once
            parts = [x for x in (before, more[columns]) if len(x)]
            before = pd.concat(parts).drop_duplicates("event_id").sort_values(["ts", "event_id"]).tail(self.n) if parts else before
        self.held.put(list(before.itertuples(index=False, name=None)))
        yield before.assign(shard=key[0])[["shard", *columns]]

    def close(self) -> None:
        pass


def latest_state(events: DataFrame, n: int = LATEST, shards: int = SHARDS) -> DataFrame:
    """(shard, ts, event_id, latency_ms, status, tokens): after each batch of a stream the n latest events of the shards that it touched. An event that comes again, or late, changes nothing that it shouldn't."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "latency_ms", "status", "tokens", F.pmod(F.xxhash64("event_id"), F.lit(shards)).cast("int").alias("shard"))
    out = "shard int, ts timestamp, event_id long, latency_ms double, status int, tokens int"
    return rows.groupBy("shard").transformWithStateInPandas(_Latest(n), outputStructType=out, outputMode="Update", timeMode="None")


def run_telemetry(events: DataFrame, folder: str, n: int = LATEST) -> list[StreamingQuery]:
    """Two queries over a stream of telemetry, each to its end: events appended under folder/history, and the latest of each shard under folder/latest, where a shard's newest batch counts. Both go on from folder/state when they are started again."""
    history = events.writeStream.foreachBatch(lambda rows, i: append_batch(rows, i, f"{folder}/history")).option("checkpointLocation", f"{folder}/state/history")
    latest = latest_state(events, n).writeStream.outputMode("update").foreachBatch(lambda rows, i: append_batch(rows, i, f"{folder}/latest")).option("checkpointLocation", f"{folder}/state/latest")
    started = [q.trigger(availableNow=True).start() for q in (history, latest)]
    for q in started:
        q.awaitTermination()
    return started


def latest_of(spark: SparkSession, folder: str, n: int = LATEST) -> DataFrame:
    """The n latest events: of each shard the rows of its newest batch, and of all these the n latest. The rows that are put in order are as many as shards hold."""
    rows = appended(spark, f"{folder}/latest", "shard int, ts timestamp, event_id long, latency_ms double, status int, tokens int")
    newest = rows.groupBy("shard").agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(newest), ["shard", "batch"]).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
