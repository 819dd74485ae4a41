"""Intrusion alerts: normalisation and the tiered as-of match with packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.packets import is_whitelisted_port, protocol_name
from packetloom.operators.lookups import in_networks, small_side
from packetloom.operators.timeline import Cuts, cut_points, running
from packetloom.vocab import WHITELISTED_NETWORKS

EVENT_SCHEMA = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("src_ip", T.StringType()), T.StructField("src", T.StringType()),
    T.StructField("dest_ip", T.StringType()), T.StructField("dest", T.StringType()),
    T.StructField("sig", T.StringType()), T.StructField("severity", T.LongType()),
    T.StructField("sid", T.LongType()),
    T.StructField("alert", T.StructType([
        T.StructField("signature", T.StringType()), T.StructField("severity", T.LongType()),
        T.StructField("signature_id", T.LongType())])),
    T.StructField("flow", T.StructType([T.StructField("alerted", T.BooleanType())])),
])


def parse_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Log lines as structs; malformed lines (no field readable) are dropped.

    The one-element explode keeps filters on the struct above the parser; pushed below it, each
    of their field references would parse the line again.
    """
    kept = [c for c in lines.columns if c != line]
    parsed = lines.select(*kept, F.explode(F.array(F.from_json(line, EVENT_SCHEMA))).alias("e"))
    readable = F.coalesce(*[F.col(f"e.{f.name}").cast("string") for f in EVENT_SCHEMA.fields]).isNotNull()
    return parsed.where(readable)


def alert_rows(lines: DataFrame) -> DataFrame:
    """Only the events of type ``alert``."""
    return parse_events(lines).where("e.event_type = 'alert'").select(
        "event_no", "ts_s", "e.src_ip", "e.dest_ip", "e.alert.signature", "e.alert.severity", "e.alert.signature_id")


def promote_flows(events: DataFrame, promote_all: bool = False) -> DataFrame:
    """Alerts pass; flow events marked alerted (or all) become alerts of severity 3 (else 5)."""
    e = F.col("e")
    is_alert = e["alert"].isNotNull()
    alerted = F.coalesce(e["flow"]["alerted"], F.lit(False))
    promoted = ~is_alert & (e["event_type"] == "flow") & (alerted | F.lit(promote_all))
    made = F.struct(
        F.concat(F.lit("Flow Event "), e["src_ip"], F.lit("->"), e["dest_ip"]).alias("signature"),
        F.when(alerted, 3).otherwise(5).cast("bigint").alias("severity"),
        F.lit(999999).cast("bigint").alias("signature_id"))
    return events.where(is_alert | promoted).withColumn("e", e.withField("alert", F.when(is_alert, e["alert"]).otherwise(made)))


def _given(*candidates: Column) -> Column:
    """First candidate that is neither missing, empty nor zero."""
    return F.coalesce(*[F.when(~c.cast("string").isin("", "0"), c) for c in candidates])


def normalise_alerts(events: DataFrame) -> DataFrame:
    """One flat row per alert; aliases stand in for missing, empty or zero fields."""
    e = F.col("e")
    return events.select(
        "event_no", "ts_s",
        F.coalesce(_given(e["src_ip"], e["src"]), F.lit("None")).alias("src_ip"),
        F.coalesce(_given(e["dest_ip"], e["dest"]), F.lit("None")).alias("dest_ip"),
        F.coalesce(_given(e["alert"]["signature"], e["sig"]), F.lit("None")).alias("signature"),
        F.coalesce(_given(e["alert"]["severity"]), e["severity"], F.lit(3)).cast("int").alias("severity"),
        F.coalesce(_given(e["alert"]["signature_id"]), e["sid"], F.lit(0)).cast("int").alias("signature_id"))


def read_alerts(lines: DataFrame, promote_all: bool = False) -> DataFrame:
    return normalise_alerts(promote_flows(parse_events(lines), promote_all))


def _latest(rows: DataFrame, alerts: DataFrame, keys: list[str], outs: dict[str, Column], cuts: Cuts) -> DataFrame:
    """Latest alert per key at or before each row; alerts of the same instant count."""
    both = rows.withColumn("_is_row", F.lit(1)).unionByName(
        alerts.withColumn("_is_row", F.lit(0)), allowMissingColumns=True)
    return running(both, keys, ["ts_s", "_is_row", "_seq"], cuts, lasts=outs).where("_is_row = 1")


def match_alerts(packets: DataFrame, alerts: DataFrame, window: float = 30.0, cuts: Cuts | None = None) -> DataFrame:
    """At most one alert per packet: newest not older than ``window`` of the best tier.

    Tier 1 has the packet's direction, 2 the reverse, 3 shares any address. The newest alert of a
    key is all a packet needs, so each lookup is a running last value, never a join of packets
    with every alert of an address: pairs (tiers 1, 2) are scanned once per packet and addresses
    (tier 3) twice.
    """
    cuts = cuts or cut_points(packets, "ts_s")
    slot = F.floor(F.col("ts_s") / F.lit(float(window)))

    def near_alerts(rows: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
        """Rows whose key has an alert in the same or the previous window-long slot. Only worth it
        while the alerted slots are few enough to broadcast; the match itself does not need it."""
        slots = hits.select(*keys, F.explode(F.array(slot, slot + 1)).alias("_slot")).distinct()
        few = small_side(slots)
        return rows if few is slots else rows.withColumn("_slot", slot).join(few, [*keys, "_slot"], "left_semi").drop("_slot")

    pair = lambda a, b: [F.least(a, b).alias("ip_a"), F.greatest(a, b).alias("ip_b")]
    found = F.struct("ts_s", F.col("event_no"))

    a_rows = alerts.select(*pair("src_ip", "dest_ip"), "ts_s", F.col("event_no").alias("_seq"),
                           "event_no", F.col("src_ip").alias("alert_src"))
    p_rows = packets.select(*pair("src_ip", "dst_ip"), "ts_s", F.col("pkt_id").alias("_seq"), "pkt_id", "src_ip", "dst_ip")
    # alerts of the pair in either direction, seen from the smaller address
    from_a = _latest(near_alerts(p_rows, a_rows, ["ip_a", "ip_b"]), a_rows, ["ip_a", "ip_b"], {
        "up": F.when(F.col("alert_src") == F.col("ip_a"), found),
        "down": F.when(F.col("alert_src") == F.col("ip_b"), found),
    }, cuts)
    upward = F.col("src_ip") == F.col("ip_a")
    pairs = from_a.select("pkt_id", F.col("ts_s").alias("at"), F.explode(F.array(
        F.struct(F.lit(1).alias("tier"), F.when(upward, F.col("up")).otherwise(F.col("down")).alias("hit")),
        F.struct(F.lit(2).alias("tier"), F.when(upward, F.col("down")).otherwise(F.col("up")).alias("hit")),
    )).alias("c"))

    a_ends = alerts.select(F.explode(F.array_distinct(F.array("src_ip", "dest_ip"))).alias("ip"), "ts_s",
                           F.col("event_no").alias("_seq"), "event_no")
    p_ends = packets.select(F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("ip"), "ts_s",
                            F.col("pkt_id").alias("_seq"), "pkt_id")
    touching = _latest(near_alerts(p_ends, a_ends, ["ip"]), a_ends, ["ip"], {"hit": F.when(F.col("_is_row") == 0, found)}, cuts).select(
        "pkt_id", F.col("ts_s").alias("at"), F.struct(F.lit(3).alias("tier"), F.col("hit")).alias("c"))

    fresh = pairs.unionByName(touching).where(F.col("c.hit").isNotNull() & (F.col("at") - F.col("c.hit.ts_s") <= window))
    rank = F.struct((-F.col("c.tier")).alias("tier"), F.col("c.hit.ts_s"), F.col("c.hit.event_no"))
    best = fresh.groupBy("pkt_id").agg(F.max(rank).alias("best"))
    return best.select("pkt_id", (-F.col("best.tier")).alias("tier"), F.col("best.event_no").alias("event_no"))


def packet_events(packets: DataFrame, alerts: DataFrame, window: float = 30.0, cuts: Cuts | None = None) -> DataFrame:
    """Every packet with its matched alert and the whitelist flag."""
    matched = match_alerts(packets, alerts, window, cuts).join(
        alerts.select("event_no", "signature", "severity"), "event_no").drop("event_no")
    return as_events(packets.join(matched, "pkt_id", "left"))


def as_events(matched: DataFrame) -> DataFrame:
    """Packet events from packets with the tier, signature and severity of their alert, if any."""
    hit = F.col("tier").isNotNull()
    flagged = in_networks(matched, {"src_white": "src_ip", "dst_white": "dst_ip"}, WHITELISTED_NETWORKS)
    return flagged.select(
        "pkt_id", "ts_s", "src_ip", F.col("sport").alias("src_port"), "dst_ip", F.col("dport").alias("dst_port"),
        protocol_name(F.col("proto")).alias("protocol"), "length", hit.alias("is_alert"), "signature", "severity",
        F.when(hit, "suricata_alert").alias("category"),
        (is_whitelisted_port(F.col("dport")) | F.col("src_white") | F.col("dst_white")).alias("whitelisted"))
