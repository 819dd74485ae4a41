"""Traffic summaries behind a dashboard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.verdicts import alert_category, severity_bucket, severity_class, severity_text


def protocol_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("protocol").agg(F.count(F.lit(1)).alias("n"))


def top_endpoints(events: DataFrame, ip: str, port: str, k: int = 5) -> DataFrame:
    """Busiest ``ip:port`` texts; the one seen first wins a tie."""
    endpoint = F.concat(F.col(ip), F.lit(":"), F.col(port).cast("string"))
    counts = events.groupBy(endpoint.alias("endpoint")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ts_s", "pkt_id")).alias("at"))
    return counts.orderBy(F.desc("n"), "at").limit(k).select("endpoint", "n")


def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    """All four severities with their counts, in one aggregation."""
    bucket = severity_bucket(F.col("severity"))
    counts = alerts.agg(*[F.count_if(bucket == s).alias(f"s{s}") for s in range(1, 5)])
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(f"s{s}").alias("n")) for s in range(1, 5)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def describe_alerts(alerts: DataFrame) -> DataFrame:
    """Severity wording, display class and attack category of every alert."""
    s = F.col("severity")
    return alerts.select("event_no", "signature", "severity", severity_text(s).alias("severity_text"),
                         severity_class(s).alias("severity_class"),
                         alert_category(F.col("signature"), F.lit(None).cast("string"), s).alias("attack_type"))


def recent(events: DataFrame, k: int, *columns: str) -> DataFrame:
    """The latest ``k`` rows, newest first."""
    return events.orderBy(F.desc("ts_s"), F.desc("pkt_id")).limit(k).select(*columns)


def session_totals(packets: DataFrame, dropped: Column) -> DataFrame:
    """Totals of a capture session with drop share and mean packet rate."""
    elapsed = F.max("ts_s") - F.min("ts_s")
    return packets.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~dropped).alias("processed"), F.count_if(dropped).alias("dropped"),
        (F.count_if(dropped) * 100.0 / F.count(F.lit(1))).alias("drop_pct"), elapsed.alias("elapsed"),
        F.when(elapsed > 0, F.try_divide(F.count(F.lit(1)), elapsed)).otherwise(F.lit(0.0)).alias("pps"))


def detection_summary(detections: DataFrame, name: Column) -> DataFrame:
    """Detections per attack name, most frequent first."""
    return detections.groupBy(name.alias("attack_name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "attack_name")


def latest_attack(attacks: DataFrame, packets: DataFrame, max_age: float = 10.0) -> DataFrame:
    """The newest attack, if at most ``max_age`` seconds older than the newest packet."""
    now = packets.agg(F.max("ts_s").alias("now"))
    last = attacks.agg(F.max_by(F.struct("pkt_id", "ts_s", "attack_name", "src", "dst"), F.struct("ts_s", "pkt_id")).alias("a"))
    return last.where(now.scalar() - F.col("a.ts_s") < max_age).select("a.*")


RECENT_PACKETS, RECENT_SIZES, RECENT_ALERTS, TOP = 20, 50, 10, 5  # rows a dashboard shows
PARTIAL = "metric string, key string, n long, first_ts double, first_id long, last_ts double, value double"
RANKED = ("top_sources", "top_destinations", "recent", "recent_alerts")


def dashboard_partials(events: DataFrame) -> DataFrame:
    """Mergeable parts of all dashboard figures, from one read of the events.

    Counts come per Arrow batch, the newest packets and alerts per task; both are merged by
    ``merged_partials``, and so are the parts of several tables.
    """
    endpoint = lambda ip, port: F.concat(F.col(ip), F.lit(":"), F.col(port).cast("string"))
    needed = events.select(
        "pkt_id", "ts_s", "protocol", endpoint("src_ip", "src_port").alias("source"), endpoint("dst_ip", "dst_port").alias("destination"),
        F.col("length").cast("double").alias("length"), "is_alert", F.col("severity").cast("double").alias("severity"),
        severity_bucket(F.col("severity")).cast("string").alias("bucket"))
    columns = [c.split()[0] for c in PARTIAL.split(", ")]

    def counted(frame: pd.DataFrame, metric: str, key: pd.Series | str) -> pd.DataFrame:
        ordered = frame.assign(key=key).sort_values(["ts_s", "pkt_id"])
        groups = ordered.groupby("key", dropna=False, sort=False)
        return pd.DataFrame({"n": groups.size(), "first_ts": groups["ts_s"].first(), "first_id": groups["pkt_id"].first(),
                             "last_ts": groups["ts_s"].last()}).reset_index().assign(metric=metric, value=np.nan)

    def newest(frame: pd.DataFrame, metric: str, value: str) -> pd.DataFrame:
        return pd.DataFrame({"metric": metric, "key": frame["pkt_id"].astype(str), "n": 1, "first_ts": frame["ts_s"], "first_id": frame["pkt_id"],
                             "last_ts": frame["ts_s"], "value": frame[value]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packets, alerts = None, None
        latest = lambda kept, frame, k: pd.concat([kept, frame]).sort_values(["ts_s", "pkt_id"]).tail(k)
        for frame in frames:
            if not len(frame):
                continue
            hit = frame[frame["is_alert"]]
            parts = [counted(frame, "total_packets", "all"), counted(frame, "protocols", frame["protocol"]),
                     counted(frame, "top_sources", frame["source"]), counted(frame, "top_destinations", frame["destination"])]
            if len(hit):
                parts += [counted(hit, "alert_count", "all"), counted(hit, "alerts_by_severity", hit["bucket"])]
                alerts = latest(alerts, hit, RECENT_ALERTS)
            packets = latest(packets, frame, RECENT_SIZES)
            yield pd.concat(parts)[columns]
        if packets is not None:
            yield newest(packets, "recent", "length")[columns]
        if alerts is not None:
            yield newest(alerts, "recent_alerts", "severity")[columns]

    return needed.mapInPandas(run, PARTIAL)


def merged_partials(partials: DataFrame) -> DataFrame:
    """One row per (metric, key) again."""
    first = F.min(F.when(F.col("first_ts").isNotNull(), F.struct("first_ts", "first_id")))
    return partials.groupBy("metric", "key").agg(
        F.sum("n").alias("n"), first.alias("first"), F.max("last_ts").alias("last_ts"), F.max("value").alias("value")).select(
        "metric", "key", "n", "first.first_ts", "first.first_id", "last_ts", "value")


def dashboard_figures(partials: DataFrame) -> DataFrame:
    """Every dashboard figure in long form (metric, key, value)."""
    figure = lambda metric, key, value: F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    zeros = [("total_packets", "all"), ("alert_count", "all"), *[("alerts_by_severity", str(s)) for s in range(1, 5)]]
    none = partials.sparkSession.createDataFrame([(m, k, 0) for m, k in zeros], "metric string, key string, n long")
    merged = merged_partials(partials.unionByName(none, allowMissingColumns=True))
    # only the ranked metrics share a window each; every other row is one of its own
    is_ranked, is_recent = F.col("metric").isin(*RANKED), F.col("metric").isin("recent", "recent_alerts")
    order = Window.partitionBy("metric", F.when(~is_ranked, F.col("key"))).orderBy(
        F.desc(F.when(is_recent, F.col("first_ts")).otherwise(F.col("n"))),
        F.when(is_recent, -F.col("first_id").cast("double")).otherwise(F.col("first_ts")), "first_id")
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= RECENT_SIZES)
    metric, rank = F.col("metric"), F.col("rank")
    key, n, value = F.col("key"), F.col("n"), F.col("value")
    shown = F.when(metric == "total_packets", F.array(
        figure("total_packets", key, n), figure("uptime", F.lit("seconds"), F.col("last_ts") - F.col("first_ts"))))
    shown = shown.when(metric == "recent", F.array_compact(F.array(
        F.when(rank <= RECENT_PACKETS, figure("recent_packets", key, value)), figure("packet_sizes", key, value))))
    shown = shown.when((metric == "recent_alerts") & (rank <= RECENT_ALERTS), F.array(figure("recent_alerts", key, value)))
    for name in ("top_sources", "top_destinations"):
        shown = shown.when((metric == name) & (rank <= TOP), F.array(figure(name, key, n)))
    for name in ("protocols", "alert_count", "alerts_by_severity"):
        shown = shown.when(metric == name, F.array(figure(name, key, n)))
    return ranked.select(F.explode(shown).alias("f")).select("f.*")


def dashboard_snapshot(events: DataFrame) -> DataFrame:
    """Every dashboard figure in long form (metric, key, value); the events are read once."""
    return dashboard_figures(dashboard_partials(events))
