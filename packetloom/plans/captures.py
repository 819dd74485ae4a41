"""Capture-file jobs: features per label, and scored packets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom import vocab
from packetloom.functions.verdicts import kdd_class_name
from packetloom.operators.features import features_69
from packetloom.plans.training import score
from packetloom.sources import pcap, sinks

def capture_features(spark: SparkSession, folder: str, label: Column | None = None) -> DataFrame:
    """69-column records of all IP packets of a capture folder, labelled by file name."""
    packets = pcap.labelled_pcaps(spark, folder)
    if label is not None:
        packets = packets.withColumn("label", label)
    return features_69(packets.withColumn("pkt_id", F.xxhash64("file", "pkt_id")), keep=["file", "label"])


def extract_captures(spark: SparkSession, folder: str, output: str) -> None:
    """Feature CSV folders, one per label."""
    sinks.write_labelled(capture_features(spark, folder), output)


def score_captures(spark: SparkSession, folder: str, model: PipelineModel, name: Callable[[Column], Column] = kdd_class_name) -> DataFrame:
    """Predicted class name of every packet of a capture folder."""
    records = capture_features(spark, folder)
    scored = score(records, model, vocab.KDD_MODEL_COLUMNS, ["pkt_id", "file", "src_ip", "dst_ip"])
    return scored.select("pkt_id", "file", "src_ip", "dst_ip", name(F.col("predicted")).alias("prediction"), "confidence")
