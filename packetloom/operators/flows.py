"""Flow and connection aggregates, and per-packet running flow features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.columns import one
from packetloom.functions.packets import TCP, flow_service, has_bit
from packetloom.operators.timeline import Cuts, cut_points, running, session_cells

FIVE_TUPLE = ["src_ip", "dst_ip", "proto", "sport", "dport"]
FLOW_KEY = ["ip_a", "ip_b", "proto", "port_a", "port_b"]
ORDER = ["ts_s", "pkt_id"]
IDLE = 300.0


def bidirectional(packets: DataFrame) -> DataFrame:
    """Add the direction-free flow key: the smaller address text first, ports follow.

    Equal addresses count as reversed.
    """
    forward = F.col("src_ip") < F.col("dst_ip")
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    return packets.select(
        "*", pick("src_ip", "dst_ip").alias("ip_a"), pick("dst_ip", "src_ip").alias("ip_b"),
        pick("sport", "dport").alias("port_a"), pick("dport", "sport").alias("port_b"),
        (~forward).alias("is_reverse"))


def running_flow(packets: DataFrame, keys: list[str] = FIVE_TUPLE, cuts: Cuts | None = None) -> DataFrame:
    """Running packet and byte counts, duration, rate and inter-arrival time per flow."""
    cuts = cuts or cut_points(packets, "ts_s")
    scanned = running(
        packets, keys, ORDER, cuts,
        sums={"flow_packets": one(), "flow_bytes": F.col("length").cast("bigint")},
        mins={"flow_start": F.col("ts_s")}, prevs={"prev_ts": F.col("ts_s")},
    )
    duration = F.col("ts_s") - F.col("flow_start")
    return scanned.withColumns({
        "flow_duration": duration,
        "packet_rate": F.when(duration > 0, F.col("flow_packets") / duration).otherwise(F.lit(0.0)),
        "packets_per_second": F.col("flow_packets") / F.greatest(duration, F.lit(0.001)),
        "iat": F.col("ts_s") - F.col("prev_ts"),
    }).drop("prev_ts")


def flow_sessions(packets: DataFrame, keys: list[str] = FIVE_TUPLE, idle: float = IDLE) -> DataFrame:
    """Flows split where they pause longer than ``idle`` seconds."""
    cells = session_cells(packets, keys, "ts_s", idle, F.count(F.lit(1)).alias("n"),
                          F.sum(F.col("length").cast("bigint")).alias("b"))
    sessions = cells.groupBy(*keys, "_session").agg(
        F.max("_last").alias("last_seen"), F.sum("n").alias("packets"), F.sum("b").alias("bytes"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_session"))
    return sessions.select(*keys, number.alias("session_no"), F.col("_session").alias("first_seen"),
                           "last_seen", "packets", "bytes")


FLAG_WORDS = 4  # the 256 flag bytes as bits of four bigints


def _flag_words(flags: Column) -> list[Column]:
    """One bit per flag byte seen, spread over four words, for ``bit_or``."""
    bit = F.expr("shiftleft(1L, tcp_flags % 64)")
    return [F.when(F.floor(flags / 64) == w, bit).otherwise(F.lit(0).cast("bigint")) for w in range(FLAG_WORDS)]


def _flag_values(words: list[str]) -> Column:
    """The flag bytes whose bits are set, ascending."""
    def of_word(number: int, word: str) -> Column:
        set_bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col(word), i) == 1)
        return F.transform(set_bits, lambda i: i + 64 * number)

    return F.concat(*[of_word(n, w) for n, w in enumerate(words)])


def _present(*values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*values))))


def bidirectional_flows(packets: DataFrame, idle: float = IDLE, cuts: Cuts | None = None) -> DataFrame:
    """One row per direction-free flow and activity period.

    A flow's state has a fixed size, so all of it combines map-side in hash aggregates: lists of
    lengths and gaps are kept as moments, and since the key names both ports, the port and service
    sets follow from the directions seen.
    """
    keyed = bidirectional(packets.select(*ORDER, *FIVE_TUPLE, "length", "tcp_flags"))
    cuts = cuts or cut_points(packets, "ts_s")
    timed = running(keyed, FLOW_KEY, ORDER, cuts, prevs={"prev_ts": F.col("ts_s")})
    pause = F.col("ts_s") - F.col("prev_ts")
    rows = timed.withColumns({
        "iat": F.when(pause <= idle, pause).otherwise(F.lit(0.0)),
        # a row after a longer pause opens the period and gives it its direction
        "opens_reverse": F.when(pause.isNull() | (pause > idle), F.col("is_reverse")),
    })
    length, is_tcp = F.col("length").cast("bigint"), F.col("proto") == TCP
    words = [f"flags_{w}" for w in range(FLAG_WORDS)]
    aggregates = {
        "n": F.count(F.lit(1)), "b": F.sum(length), "len_min": F.min("length"), "len_max": F.max("length"), "len_sq": F.sum(length * length),
        "iat_sum": F.sum("iat"), "iat_max": F.max("iat"), "opened_reverse": F.max("opens_reverse"),
        "any_forward": F.bool_or(~F.col("is_reverse")), "any_reverse": F.bool_or("is_reverse"),
        **{w: F.bit_or(F.when(is_tcp, c).otherwise(F.lit(0).cast("bigint"))) for w, c in zip(words, _flag_words(F.col("tcp_flags")))},
    }
    cells = session_cells(rows, FLOW_KEY, "ts_s", idle, *[c.alias(n) for n, c in aggregates.items()])
    merged = cells.groupBy(*FLOW_KEY, F.col("_session").alias("first_seen")).agg(
        F.max("_last").alias("last_seen"), F.sum("n").alias("packets"), F.sum("b").alias("bytes"),
        F.min("len_min").alias("min_length"), F.max("len_max").alias("max_length"), F.sum("len_sq").alias("length_squares"),
        F.sum("iat_sum").alias("iat_total"), F.max("iat_max").alias("iat_max"), F.max("opened_reverse").alias("is_reverse"),
        F.bool_or("any_forward").alias("fwd"), F.bool_or("any_reverse").alias("rev"), *[F.bit_or(w).alias(w) for w in words])
    fwd, rev = F.col("fwd") & is_tcp, F.col("rev") & is_tcp
    port_a, port_b, proto = F.col("port_a"), F.col("port_b"), F.col("proto")
    return merged.select(
        *FLOW_KEY, "first_seen", "last_seen", "packets", "bytes", "min_length", "max_length", "length_squares", "iat_total", "iat_max", "is_reverse",
        _present(F.when(fwd, port_a), F.when(rev, port_b)).alias("src_ports"),
        _present(F.when(fwd, port_b), F.when(rev, port_a)).alias("dst_ports"),
        _flag_values(words).alias("flag_values"),
        _present(F.when(fwd, flow_service(proto, port_b)), F.when(rev, flow_service(proto, port_a))).alias("services"))


def flow_totals(flows: DataFrame) -> DataFrame:
    """Flows, packets, bytes and mean duration over all flows."""
    return flows.agg(
        F.count(F.lit(1)).alias("total_flows"), F.sum("packets").alias("total_packets"),
        F.sum("bytes").alias("total_bytes"), F.avg(F.col("last_seen") - F.col("first_seen")).alias("avg_flow_duration"))


def connections(packets: DataFrame) -> DataFrame:
    """Directional connections: packets, bytes sent, flags seen, first and last packet."""
    is_tcp = F.col("proto") == TCP
    flags = F.array_compact(F.array(*[
        F.when(is_tcp & has_bit(F.col("tcp_flags"), n), F.lit(n)) for n in ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR")
    ]))
    seen = [F.bool_or(F.array_contains(flags, n)).alias(n) for n in ("ACK", "FIN", "PSH", "RST", "SYN", "URG", "ECE", "CWR")]
    counted = packets.groupBy(*FIVE_TUPLE).agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum(F.col("length").cast("bigint")).alias("bytes_sent"),
        F.min("ts_s").alias("start_time"), F.max("ts_s").alias("last_seen"), *seen)
    names = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in ("ACK", "CWR", "ECE", "FIN", "PSH", "RST", "SYN", "URG")]))
    return counted.select(*FIVE_TUPLE, "packet_count", "bytes_sent", "start_time", "last_seen",
                          F.array_join(names, ",").alias("flags"))


def flow_flag_counts(packets: DataFrame) -> DataFrame:
    """SYN, ACK, FIN and RST counts, packets, bytes and mean size per directional flow."""
    is_tcp = F.col("proto") == TCP
    return packets.groupBy(*FIVE_TUPLE).agg(
        *[F.count_if(is_tcp & has_bit(F.col("tcp_flags"), n)).alias(f"{n.lower()}_count") for n in ("SYN", "ACK", "FIN", "RST")],
        F.count(F.lit(1)).alias("packet_count"), F.sum(F.col("length").cast("bigint")).alias("byte_count"),
        F.avg("length").alias("avg_packet_size"))
