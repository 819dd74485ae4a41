"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Vectored reads keep an off-heap copy of a whole column chunk in every reading thread: off, as texts make large chunks."""
    return spark.read.option("parquet.hadoop.vectored.io.enabled", "false").parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns cannot clash with working ones."""
    return df.select(*[F.col(f"`{n}`").alias(n) for n in names])


def joined(items: Column) -> Column:
    """Comma-joined text of an array of strings."""
    return F.array_join(items, ",")
