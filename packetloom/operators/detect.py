"""Per-packet detections and the live decision chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.packets import TCP, is_common_port, tcp_anomaly
from packetloom.functions.payload import is_shellcode, payload_text, text_entropy
from packetloom.operators.flows import FIVE_TUPLE, ORDER
from packetloom.operators.rates import flood_alerts
from packetloom.operators.scans import classify_scans, horizontal_scans, vertical_scans
from packetloom.operators.timeline import Cuts, cut_points, running

Detector = Callable[[DataFrame], Column]


def _shellcode(df: DataFrame) -> Column:
    """Shellcode verdict on the raw payload bytes, captured or text; entropy is over the characters."""
    return F.when(is_shellcode(df["payload"].cast("binary"), text_entropy(payload_text(df))), "SHELLCODE_DETECTED")


# name -> Column builder; callers extend it with their own detectors
ROW_DETECTORS: dict[str, Detector] = {
    "tcp_anomaly": lambda df: tcp_anomaly(df["tcp_flags"], df["tcp_window"], df["proto"] == TCP),
    "shellcode": _shellcode,
}


def detections(
    packets: DataFrame, predictions: DataFrame | None = None, flood_threshold: float = 1000.0,
    detectors: dict[str, Detector] | None = None, cuts: Cuts | None = None,
) -> DataFrame:
    """All detections, one row per packet and detector.

    Detectors of single packets are columns exploded in place; the stateful ones emit only their
    hits, so the results meet in a union instead of packet-wide joins.
    """
    cuts = cuts or cut_points(packets, "ts_s")
    row_hits = F.array(*[build(packets) for build in (detectors or ROW_DETECTORS).values()])
    parts = [
        packets.select("pkt_id", F.explode(F.array_distinct(F.array_compact(row_hits))).alias("detection")),
        classify_scans(packets, cuts=cuts).select("pkt_id", F.col("alert").alias("detection")),
        flood_alerts(packets, flood_threshold, cuts=cuts).select("pkt_id", F.col("alert").alias("detection")),
    ]
    if predictions is not None:
        sure = predictions.where("confidence > 0.8")
        parts.append(sure.select("pkt_id", F.concat(F.lit("ML_DETECTION_"), F.col("predicted").cast("string")).alias("detection")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found  # a detector names a packet once, and no two share a text


def decision_chain(packets: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """What the live chain does with each packet.

    ``common_port``: first packet of a flow on an everyday port, remembered as benign;
    ``cached_benign``: later packets of such a flow; ``scan_alert``: starts or extends a scan among
    the packets left; ``score``: goes on to the model.
    """
    cuts = cuts or cut_points(packets, "ts_s")
    common = is_common_port(F.col("sport")) | is_common_port(F.col("dport"))
    fast = packets.where(common).select(*ORDER, *FIVE_TUPLE)
    counted = running(fast, FIVE_TUPLE, ORDER, cuts, sums={"nth": F.lit(1).cast("bigint")})
    decided = counted.select("pkt_id", F.when(F.col("nth") > 1, "cached_benign").otherwise("common_port").alias("decision"))
    rest = packets.where(~common)
    scans = horizontal_scans(rest, cuts=cuts).select("pkt_id").unionByName(vertical_scans(rest, cuts=cuts).select("pkt_id"))
    scored = rest.select("pkt_id").join(scans.distinct().withColumn("_scan", F.lit(True)), "pkt_id", "left")
    return decided.unionByName(scored.select(
        "pkt_id", F.when(F.col("_scan"), "scan_alert").otherwise("score").alias("decision")))
