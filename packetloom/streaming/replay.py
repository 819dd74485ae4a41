"""Run a streaming job over a batch table by landing it slice by slice."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.session import run_folder
from packetloom.streaming.sources import packet_stream

FAR = 10_000_000.0
PARTITIONS_CONF = "spark.sql.shuffle.partitions"
ROWS_PER_PARTITION = 1_000_000


def replay(table: DataFrame, run: Callable[[Callable[[], DataFrame], str, str], None], slices: int = 2, close: bool = False,
           origin: float = 0.0, read: Callable[[str], DataFrame] | None = None, by: str = "ts_s") -> DataFrame:
    """Land ``table`` in ``slices`` time slices, run the job after each from its checkpoint, and
    return what it wrote.

    ``run(stream, path, checkpoint)`` starts one pass. ``close`` lands a final far-future row that
    moves the watermark past every open window. ``read`` reads outputs that are not one table. ``by`` is
    the second at which a row arrives, where that is not its own time.
    """
    spark = table.sparkSession
    landing, path, checkpoint = (run_folder(spark, n) for n in ("landing", "out", "checkpoint"))
    lo, hi, n = table.agg(F.min(by), F.max(by), F.count(F.lit(1))).first()
    width = (hi - lo) / slices or 1.0
    stream = functools.partial(packet_stream, spark, landing, table.schema, origin=origin)
    # a streaming query fixes its state partitions at the first start and never coalesces them:
    # size them to the table, not beyond the session's setting
    session_partitions = spark.conf.get(PARTITIONS_CONF)
    wanted = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_PARTITION))
    spark.conf.set(PARTITIONS_CONF, str(min(int(session_partitions), wanted)))
    try:
        _land_and_run(table, landing, lambda: run(stream, path, checkpoint), lo, hi, width, slices, close, by)
    finally:
        spark.conf.set(PARTITIONS_CONF, session_partitions)
    return read(path) if read else spark.read.parquet(path)


def _land_and_run(table: DataFrame, landing: str, step: Callable[[], None], lo: float, hi: float, width: float, slices: int, close: bool, by: str) -> None:
    for i in range(slices):
        inside = (F.col(by) >= lo + i * width) & ((F.col(by) < lo + (i + 1) * width) if i + 1 < slices else F.lit(True))
        table.where(inside).write.mode("append").parquet(landing)
        step()
    if close:
        last = table.where(F.col(by) == hi).limit(1).withColumn("ts_s", F.lit(hi + FAR))
        last.write.mode("append").parquet(landing)
        step()
