"""Table, metrics and model sinks."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from packetloom.operators.boosting import Boosted


def append_csv(df: DataFrame, path: str) -> None:
    """Append as CSV; every part carries its header, so readers see it once."""
    df.write.mode("append").option("header", True).csv(path)


def overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append to a Parquet table such as ``alerts`` or ``packet_events``."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_labelled(df: DataFrame, folder: str, label: str = "label") -> None:
    """One CSV folder per label."""
    df.write.mode("overwrite").partitionBy(label).option("header", True).csv(folder)


def write_json(spark: SparkSession, values: dict, path: str) -> None:
    """A small JSON side file (feature names, metrics)."""
    spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def save_model(model: PipelineModel | Boosted, path: str, metadata: dict) -> None:
    """The fitted pipeline, or the boosted class trees as JSON, with its metadata next to it."""
    if isinstance(model, Boosted):
        write_json(SparkSession.active(), {"boosted": model.to_json()}, f"{path}/trees")
    else:
        model.write().overwrite().save(f"{path}/model")
    write_json(SparkSession.active(), {**metadata, "kind": "boosted"} if isinstance(model, Boosted) else metadata, f"{path}/metadata")


def load_model(path: str) -> tuple[PipelineModel | Boosted, dict]:
    spark = SparkSession.active()
    metadata = read_json(spark, f"{path}/metadata")
    if metadata.get("kind") == "boosted":
        return Boosted.from_json(read_json(spark, f"{path}/trees")["boosted"]), metadata
    return PipelineModel.load(f"{path}/model"), metadata


def append_leaderboard(row: dict, path: str) -> None:
    """One result row to the leaderboard table."""
    spark = SparkSession.active()
    spark.createDataFrame([row]).write.mode("append").parquet(path)
