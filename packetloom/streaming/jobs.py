"""Streaming jobs: built-in windows, sinks and the dashboard tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetloom.functions.verdicts import load_band
from packetloom.operators.flows import FIVE_TUPLE
from packetloom.operators.traffic import dashboard_figures, dashboard_partials, merged_partials
from packetloom.streaming.state import best_candidate

MICRO_BATCH = "500 milliseconds"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """State on disk, as maps, lists and timers need it. A query keeps the settings it starts with."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def throughput_stream(packets: DataFrame, dropped: Column, attack: Column, seconds: int = 2) -> DataFrame:
    """Rates per tumbling window, emitted when the watermark closes it."""
    counts = packets.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~dropped).alias("processed"), F.count_if(dropped).alias("dropped"),
        F.count_if(attack).alias("attacks"))
    pps = F.col("total") / F.lit(float(seconds))
    return counts.select(
        F.unix_seconds(F.col("w.start")).alias("window_start"), "total", "processed", "dropped", "attacks", pps.alias("pps"),
        (F.col("dropped") / F.col("total") * 100.0).alias("drop_pct"), (F.col("attacks") / F.lit(float(seconds))).alias("attacks_per_s"),
        load_band(pps).alias("load"))


def prediction_counts_stream(predictions: DataFrame, label: str, seconds: int = 30) -> DataFrame:
    return predictions.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), label).agg(F.count(F.lit(1)).alias("n")).select(
        F.unix_seconds(F.col("w.start")).alias("window_start"), label, "n")


def flood_stream(packets: DataFrame, threshold: float = 1000.0, window: int = 10) -> DataFrame:
    """Sliding rate, one step per second: the flooding windows."""
    counts = packets.groupBy(F.window("ts", f"{window} seconds", "1 second").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    pps = F.col("n") / F.lit(float(window))
    return counts.select(F.unix_seconds(F.col("w.start")).alias("window_start"), pps.alias("pps")).where(F.col("pps") > threshold)


def flow_session_stream(packets: DataFrame, keys: list[str] = FIVE_TUPLE, idle: int = 300) -> DataFrame:
    """Flows split where they pause longer than ``idle`` seconds, emitted once closed."""
    # a gap of exactly ``idle`` stays inside: the built-in window merges touching intervals
    sessions = packets.groupBy(*keys, F.session_window("ts", f"{idle} seconds").alias("w")).agg(
        F.min("ts_s").alias("first_seen"), F.max("ts_s").alias("last_seen"), F.count(F.lit(1)).alias("packets"),
        F.sum(F.col("length").cast("bigint")).alias("bytes"))
    return sessions.drop("w")


def score_stream(features: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any DataFrame scorer, such as a fitted pipeline's ``transform``, on the stream."""
    return scorer(features)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has landed, append it to a table exactly once, and stop."""
    with _rocksdb(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(
            "append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows that came too late for the watermark, over the progress Spark still holds of a query."""
    return sum(operator.numRowsDroppedByWatermark for progress in query.recentProgress for operator in progress.stateOperators)


def run_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], continuous: bool = False) -> StreamingQuery:
    """``foreachBatch`` over what has landed, or in micro-batches until the returned query is stopped."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": MICRO_BATCH} if continuous else {"availableNow": True}
    with _rocksdb(stream.sparkSession):
        query = writer.trigger(**trigger).start()
    if not continuous:
        query.awaitTermination()
    return query


def batch_table(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch's rows to its own partition: a repeated batch overwrites itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def fuse_to_table(candidates: DataFrame, path: str, checkpoint: str) -> None:
    """Best alert per packet into ``path``; the candidates of a packet share a micro-batch."""
    run_batches(candidates, checkpoint, lambda df, i: batch_table(best_candidate(df), path, i))


def dashboard_to_table(events: DataFrame, path: str, checkpoint: str) -> None:
    """Mergeable figures of every micro-batch; ``read_dashboard`` combines them."""
    run_batches(events, checkpoint, lambda df, i: batch_table(merged_partials(dashboard_partials(df)), path, i))


def read_dashboard(spark: SparkSession, path: str) -> DataFrame:
    """Current figures in long form (metric, key, value), from all batches so far."""
    return dashboard_figures(spark.read.parquet(path).drop("batch"))


def compact_dashboard(spark: SparkSession, path: str, target: str) -> None:
    """All batches so far as one, into another table: ``read_dashboard`` gives the same figures from it."""
    batch_table(merged_partials(spark.read.parquet(path).drop("batch")), target, 0)


def on_alert(alerts: DataFrame, checkpoint: str, callback: Callable[[DataFrame, int], None]) -> None:
    """Hand every micro-batch of alerts to a callback."""
    run_batches(alerts, checkpoint, callback)
