"""Traffic rates: flood test, tumbling throughput and prediction counts, host/service counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.columns import one
from packetloom.functions.packets import connection_flag_exact, is_tcp, service_name
from packetloom.functions.verdicts import load_band
from packetloom.operators.lookups import small_side
from packetloom.operators.timeline import Cuts, cut_points, trailing
from packetloom.vocab import SERVICES_69


def flood_rate(packets: DataFrame, threshold: float = 1000.0, window: float = 10.0,
               per_target: bool = False, cuts: Cuts | None = None) -> DataFrame:
    """Packets per second over the trailing window at every packet, and the flood verdict."""
    keys = ["dst_ip"] if per_target else []
    counted = trailing(packets.select("pkt_id", "ts_s", *keys), keys, "ts_s", "pkt_id", window, {"n": one()}, cuts)
    pps = F.col("n") / F.lit(float(window))
    return counted.select("pkt_id", "ts_s", *keys, pps.alias("pps"), (pps > threshold).alias("is_flood"))


def flood_alerts(packets: DataFrame, threshold: float = 1000.0, window: float = 10.0,
                 cuts: Cuts | None = None) -> DataFrame:
    """Only the flooding packets. Seconds whose window cannot reach the threshold are dropped by
    their per-second counts before any packet is ordered."""
    cuts = cuts or cut_points(packets, "ts_s")
    seconds = packets.groupBy(F.floor("ts_s").alias("sec")).agg(F.count(F.lit(1)).alias("n"))
    reach = int(-(-window // 1)) + 1
    # a packet in second s sees packets of the seconds s - reach .. s
    bounds = seconds.select(F.explode(F.sequence(F.col("sec"), F.col("sec") + reach)).alias("sec"), "n")
    hot = bounds.groupBy("sec").agg(F.sum("n").alias("most")).where(F.col("most") > threshold * window)
    needed = hot.select(F.explode(F.sequence(F.col("sec") - reach, F.col("sec"))).alias("sec")).distinct()
    kept = packets.withColumn("sec", F.floor("ts_s")).join(small_side(needed), "sec", "left_semi")
    found = flood_rate(kept, threshold, window, cuts=cuts).where("is_flood")
    return found.withColumn("alert", F.format_string("POTENTIAL_DOS_DETECTED: %.1f packets/second", "pps"))


def tumbling(ts: str, seconds: int) -> Column:
    return F.floor(F.col(ts) / seconds) * seconds


def throughput(packets: DataFrame, dropped: Column, attack: Column, seconds: int = 2) -> DataFrame:
    """Rates per tumbling window: packets, processed, dropped, drop percentage, attacks, load."""
    counts = packets.groupBy(tumbling("ts_s", seconds).alias("window_start")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~dropped).alias("processed"),
        F.count_if(dropped).alias("dropped"),
        F.count_if(attack).alias("attacks"),
    )
    pps = F.col("total") / F.lit(float(seconds))
    return counts.select(
        "*", pps.alias("pps"), (F.col("dropped") / F.col("total") * 100.0).alias("drop_pct"),
        (F.col("attacks") / F.lit(float(seconds))).alias("attacks_per_s"), load_band(pps).alias("load"))


def prediction_counts(predictions: DataFrame, label: str, seconds: int = 30) -> DataFrame:
    """Predictions per label and tumbling window."""
    return predictions.groupBy(tumbling("ts_s", seconds).alias("window_start"), label).agg(F.count(F.lit(1)).alias("n"))


def host_service_counts(packets: DataFrame, window: float = 2.0, cuts: Cuts | None = None) -> DataFrame:
    """Connections of the past seconds to the same host and to the same host and service, with
    the shares of half-open (S0) and rejected (REJ) ones."""
    state = connection_flag_exact(F.col("tcp_flags"), is_tcp())
    base = packets.select(
        "pkt_id", "ts_s", "dst_ip", service_name(F.col("proto"), F.col("dport"), SERVICES_69).alias("service"),
        (state == "S0").cast("bigint").alias("s0"), (state == "REJ").cast("bigint").alias("rej"))
    cuts = cuts or cut_points(packets, "ts_s")
    by_host = trailing(base, ["dst_ip"], "ts_s", "pkt_id", window, {
        "count": one(), "s0_n": F.col("s0"), "rej_n": F.col("rej")}, cuts)
    by_service = trailing(by_host, ["dst_ip", "service"], "ts_s", "pkt_id", window, {
        "srv_count": one(), "srv_s0_n": F.col("s0"), "srv_rej_n": F.col("rej")}, cuts)
    share = lambda part, whole: F.col(part) / F.col(whole)
    return by_service.select(
        "pkt_id", "dst_ip", "service", "count", "srv_count",
        share("s0_n", "count").alias("serror_rate"), share("rej_n", "count").alias("rerror_rate"),
        share("srv_s0_n", "srv_count").alias("srv_serror_rate"),
        share("srv_rej_n", "srv_count").alias("srv_rerror_rate"),
        share("srv_count", "count").alias("same_srv_rate"))
