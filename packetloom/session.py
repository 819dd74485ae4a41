"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# paths of the tables written below the innermost ``settled`` call
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def build_session(app: str = "packetloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` wins over the defaults.

    ``master`` is left to spark-submit unless given, so the same code runs on a cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for name, value in {**defaults, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is named (tests)."""
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="packetloom-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one written table."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a finished write are of no use: let Spark remove them when it ends."""
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_CONF, before)


def materialise(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: survives executor loss.

    With ``by`` the rows of each value of that column are files of their own.
    """
    spark = df.sparkSession
    path = run_folder(spark, name)
    with _shuffles_dropped(spark):
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(by) if by else writer).parquet(path)
    written = _written.get()
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Materialise what ``build`` returns, then delete the tables it wrote on the way.

    Only for results that are the one thing still read from ``build``'s work: its tables are gone.
    """
    steps: list[str] = []
    token = _written.set(steps)
    try:
        result = build()
    finally:
        _written.reset(token)
    table = materialise(result, name)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in steps:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    return table
