"""Port-scan detectors on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.timeline import Cuts, cut_points, running, session_cells

ORDER = ["ts_s", "pkt_id"]


def scan_state(packets: DataFrame, idle: float = 60.0, cuts: Cuts | None = None) -> DataFrame:
    """Running distinct ports and targets per source since it was last idle longer than ``idle``.

    The counts change only where a port or target shows up for the first time in a session. These
    first sightings come from pre-aggregated rows; packets then look up the latest one at or
    before them in a balanced scan, so a scanning host never lands in one task.
    """
    cuts = cuts or cut_points(packets, "ts_s")
    seen = packets.groupBy("src_ip", "dst_ip", "dport", F.floor(F.col("ts_s") / idle).alias("slot")).agg(
        F.min(F.struct(*ORDER)).alias("at"), F.max("ts_s").alias("until"))
    spans = seen.select("src_ip", "dst_ip", "dport", "slot", "at", "until")
    sessions = session_cells(
        spans.select("src_ip", F.explode(F.array(F.col("at.ts_s"), F.col("until"))).alias("ts")),
        ["src_ip"], "ts", idle,
    ).select("src_ip", F.col("_cell").alias("slot"), "_session")
    cells = spans.join(sessions, ["src_ip", "slot"])

    # ports and targets together: one row per distinct value and session, at its first packet
    values = cells.select("src_ip", "_session", "at", F.explode(F.array(
        F.struct(F.lit(1).alias("is_port"), F.col("dport").cast("string").alias("value")),
        F.struct(F.lit(0).alias("is_port"), F.col("dst_ip").alias("value")))).alias("v"))
    firsts = values.groupBy("src_ip", "_session", "v").agg(F.min("at").alias("at"))
    sightings = firsts.groupBy("src_ip", "_session", "at").agg(
        F.count_if(F.col("v.is_port") == 1).alias("new_port"), F.count_if(F.col("v.is_port") == 0).alias("new_target"),
    ).select("src_ip", "_session", "at.*", "new_port", "new_target")
    counted = running(sightings, ["src_ip", "_session"], ORDER, cuts,
                      sums={"n_ports": F.col("new_port"), "n_targets": F.col("new_target")})

    changes = counted.select("src_ip", *ORDER, "n_ports", "n_targets", F.lit(0).alias("_row"))
    rows = packets.select("src_ip", *ORDER, "dst_ip", "dport", F.lit(1).alias("_row"))
    scanned = running(
        rows.unionByName(changes, allowMissingColumns=True), ["src_ip"], ["ts_s", "pkt_id", "_row"], cuts,
        lasts={"ports_seen": F.col("n_ports"), "targets_seen": F.col("n_targets")},
    )
    return scanned.where("_row = 1").select(
        "pkt_id", "ts_s", "src_ip", "dst_ip", "dport",
        F.col("ports_seen").alias("n_ports"), F.col("targets_seen").alias("n_targets"))


def scan_verdict(state: DataFrame, threshold: int = 5) -> DataFrame:
    """Packets of a scan with its kind and alert text, from running counts. The kinds are tested
    in this order: many ports on one target, one port on many targets, many of both."""
    ports, targets = F.col("n_ports"), F.col("n_targets")
    kind = (
        F.when((ports >= threshold) & (targets == 1), "HORIZONTAL_SCAN")
        .when((targets >= threshold) & (ports == 1), "VERTICAL_SCAN")
        .when((targets >= threshold) & (ports >= threshold), "DISTRIBUTED_SCAN")
    )
    alert = (
        F.when(F.col("scan") == "HORIZONTAL_SCAN",
               F.format_string("HORIZONTAL_SCAN from %s to %s (%d ports)", "src_ip", "dst_ip", ports))
        .when(F.col("scan") == "VERTICAL_SCAN",
              F.format_string("VERTICAL_SCAN from %s (port %d to %d hosts)", "src_ip", "dport", targets))
        .otherwise(F.format_string("DISTRIBUTED_SCAN from %s (%d ports to %d hosts)", "src_ip", ports, targets))
    )
    return state.withColumn("scan", kind).where("scan is not null").withColumn("alert", alert)


def classify_scans(packets: DataFrame, threshold: int = 5, idle: float = 60.0, cuts: Cuts | None = None) -> DataFrame:
    return scan_verdict(scan_state(packets, idle, cuts), threshold)


def window_scans(
    packets: DataFrame, pair: list[str], value: str, threshold: int = 5, window: float = 60.0,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Packets that bring a new ``value`` to ``pair`` while the last ``window`` seconds hold at
    least ``threshold`` distinct values.

    A value counts from its first packet until ``window`` after its last one, so its gap sessions
    are +1/-1 steps and the distinct count is their running sum. Packets are pre-aggregated to one
    row per (pair, value, window cell) before anything is ordered.
    """
    cuts = cuts or cut_points(packets, "ts_s")
    used = packets.where(F.col("proto").isin(6, 17) & (F.col("dport") > 0))
    cells = session_cells(used, [*pair, value], "ts_s", window, F.min(F.struct(*ORDER)).alias("at"))
    spans = cells.groupBy(*pair, value, "_session").agg(F.min("at").alias("at"), F.max("_last").alias("until"))
    steps = spans.select(*pair, value, F.explode(F.array(
        F.struct(F.col("at.ts_s").alias("ts_s"), F.lit(0).alias("leave"), F.col("at.pkt_id").alias("pkt_id"),
                 F.lit(1).cast("bigint").alias("step")),
        F.struct((F.col("until") + window).alias("ts_s"), F.lit(1).alias("leave"), F.col("at.pkt_id").alias("pkt_id"),
                 F.lit(-1).cast("bigint").alias("step")),
    )).alias("s")).select(*pair, value, "s.*")
    counted = running(steps, pair, ["ts_s", "leave", "pkt_id"], cuts, sums={"n_distinct": F.col("step")})
    return counted.where((F.col("leave") == 0) & (F.col("n_distinct") >= threshold)).select(
        "pkt_id", "ts_s", *pair, value, "n_distinct")


def horizontal_scans(packets: DataFrame, threshold: int = 5, window: float = 60.0, cuts: Cuts | None = None) -> DataFrame:
    """Many ports of one host: distinct destination ports per (source, destination)."""
    found = window_scans(packets, ["src_ip", "dst_ip"], "dport", threshold, window, cuts)
    return found.withColumn("alert", F.format_string(
        "HORIZONTAL_PORT_SCAN from %s to %s (%d ports)", "src_ip", "dst_ip", "n_distinct"))


def vertical_scans(packets: DataFrame, threshold: int = 5, window: float = 60.0, cuts: Cuts | None = None) -> DataFrame:
    """One port on many hosts: distinct destinations per (source, destination port)."""
    found = window_scans(packets, ["src_ip", "dport"], "dst_ip", threshold, window, cuts)
    return found.withColumn("alert", F.format_string(
        "VERTICAL_PORT_SCAN from %s (port %d to %d hosts)", "src_ip", "dport", "n_distinct"))
