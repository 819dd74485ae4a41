"""Wide per-packet feature records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import vocab
from packetloom.functions import packets as P
from packetloom.functions import payload as B
from packetloom.functions.columns import flag, one_hot
from packetloom.operators.flows import FIVE_TUPLE, running_flow
from packetloom.operators.greedy import flow_reset
from packetloom.operators.timeline import Cuts

def _zero_unless(condition: Column, col: Column) -> Column:
    return F.when(condition, col).otherwise(0)


def payload_bytes(payload: str = "payload") -> Column:
    """Length of the payload in bytes, 0 when there is none."""
    return F.coalesce(F.octet_length(payload), F.lit(0))


def _captured(df: DataFrame, name: str, otherwise: Column) -> Column:
    """A header field where the capture delivers it."""
    return F.coalesce(df[name], otherwise) if name in df.columns else otherwise


def header_features(packets: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """Header fields, running flow timing and payload statistics of every packet.

    Sequence and acknowledgement numbers follow where the capture has them.
    """
    flow = running_flow(packets, cuts=cuts)
    text = B.payload_text(flow)
    return flow.select(
        "pkt_id", "src_ip", "dst_ip", F.col("length").alias("ip_len"), F.col("ttl").alias("ip_ttl"),
        F.col("proto").alias("ip_proto"), "sport", "dport",
        F.when(P.is_tcp(), F.col("tcp_flags")).alias("tcp_flags"), F.when(P.is_tcp(), F.col("tcp_window")).alias("tcp_window"),
        F.when(P.is_udp(), _captured(flow, "udp_len", F.col("length") - 20)).alias("udp_len"), "flow_duration", "packets_per_second",
        F.length("payload").alias("payload_length"), B.text_entropy(text).alias("entropy"), B.printable_ratio(text).alias("printable_ratio"),
        *[F.when(P.is_tcp(), F.col(c)).alias(c) for c in ("tcp_seq", "tcp_ack") if c in flow.columns])


def _features_47(base: DataFrame, entropy: bool) -> DataFrame:
    service = P.service_name(F.col("proto"), F.col("dport"), vocab.SERVICES_47)
    state = P.connection_flag_exact(F.col("tcp_flags"), P.is_tcp())
    columns = [
        "pkt_id", F.col("ts_s").alias("duration"), payload_bytes().alias("src_bytes"), F.lit(0).alias("dst_bytes"),
        P.land_hosts_and_ports(F.col("src_ip"), F.col("dst_ip"), F.col("sport"), F.col("dport")).alias("land"),
        *one_hot(P.protocol_text(F.col("proto")), vocab.PROTOCOLS_47, "protocol_type"),
        *one_hot(F.col("_service"), vocab.SERVICE_COLUMNS_47, "service"),
        *one_hot(F.col("_state"), vocab.FLAG_COLUMNS_47, "flag"),
        _zero_unless(P.is_tcp(), F.col("sport")).alias("tcp_sport"), _zero_unless(P.is_tcp(), F.col("dport")).alias("tcp_dport"),
        _zero_unless(P.is_tcp(), F.col("tcp_window")).alias("tcp_window"), *P.flag_bits(F.col("tcp_flags"), P.is_tcp()),
        _zero_unless(P.is_udp(), F.col("sport")).alias("udp_sport"), _zero_unless(P.is_udp(), F.col("dport")).alias("udp_dport"),
        _zero_unless(P.is_udp(), _captured(base, "udp_len", F.col("length") - 20)).alias("udp_len"),
        _zero_unless(F.col("proto") == P.ICMP, _captured(base, "icmp_type", F.lit(0))).alias("icmp_type"),
        _zero_unless(F.col("proto") == P.ICMP, _captured(base, "icmp_code", F.lit(0))).alias("icmp_code"),
        "flow_packet_count", "flow_duration", "packet_rate",
    ]
    if entropy:
        columns.append(B.byte_entropy(F.col("payload").cast("binary")).alias("payload_entropy"))
    return base.withColumns({"_service": service, "_state": state}).select(*columns)


def features_47(packets: DataFrame, entropy: bool = True, reset: float | None = 60.0, cuts: Cuts | None = None) -> DataFrame:
    """The 47-column record. Flow counters restart after ``reset`` seconds, or never if None."""
    if reset is None:
        base = running_flow(packets, cuts=cuts).withColumnRenamed("flow_packets", "flow_packet_count")
    else:
        timing = flow_reset(packets, FIVE_TUPLE, reset).select("pkt_id", "flow_packet_count", "flow_duration", "packet_rate")
        base = packets.join(timing, "pkt_id")
    return _features_47(base, entropy)


def features_69(packets: DataFrame, cuts: Cuts | None = None, keep: list[str] | None = None) -> DataFrame:
    """The 69-column connection record with running flow counts; columns to ``keep`` come along."""
    service = P.service_name(F.col("proto"), F.col("dport"), vocab.SERVICES_69)
    state = P.connection_flag_exact(F.col("tcp_flags"), P.is_tcp())
    zero = lambda names, value: [F.lit(value).alias(n) for n in names]
    return running_flow(packets, cuts=cuts).withColumns({"_service": service, "_state": state}).select(
        "pkt_id", "src_ip", "dst_ip", P.land_hosts(F.col("src_ip"), F.col("dst_ip")).alias("land"),
        *zero(vocab.ZERO_FIELDS_69, 0), "sport", "dport", F.col("length").alias("packet_size"), "ttl",
        payload_bytes().alias("src_bytes"), F.lit(0).alias("dst_bytes"), F.col("flow_duration").alias("duration"),
        *[F.col("flow_packets").alias(n) for n in vocab.COUNT_FIELDS_69],
        *zero(vocab.ZERO_RATES_69, 0.0), *zero(vocab.ONE_RATES_69, 1.0),
        *one_hot(P.protocol_text(F.col("proto")), vocab.PROTOCOLS_69, "protocol_type"),
        *one_hot(F.col("_service"), vocab.SERVICE_COLUMNS_69, "service"),
        *one_hot(F.col("_state"), vocab.FLAG_COLUMNS_69, "flag"), *(keep or []))


def labelled_capture(packets: DataFrame, label: str, count: int | None = None, cuts: Cuts | None = None) -> DataFrame:
    """69-column records of IP packets with flow id and a constant label; the first ``count``."""
    is_ip = packets.where(F.col("ip_version").isin(4, 6)) if "ip_version" in packets.columns else packets
    ids = F.concat_ws("-", "src_ip", "dst_ip", P.protocol_text(F.col("proto")), F.col("sport").cast("string"), F.col("dport").cast("string"))
    chosen = is_ip if count is None else is_ip.orderBy("ts_s", "pkt_id").limit(count)
    return features_69(chosen.withColumn("flow_id", ids), cuts, ["flow_id"]).withColumn("label", F.lit(label))


def flow_rates(src_bytes: Column, dst_bytes: Column, flow_duration: Column, packet_count: Column) -> dict[str, Column]:
    """Rates, inter-arrival estimates and volume marks of one flow record."""
    duration = F.greatest(F.lit(0.001), flow_duration)
    n = F.greatest(F.lit(1), packet_count)
    total = src_bytes + dst_bytes
    mean = F.when(n > 1, duration / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(0.0))
    return {
        "duration": duration, "flow_duration": duration,
        "fwd_packets/s": n / duration, "flow_packets/s": n / duration,
        "fwd_iat_mean": mean, "fwd_iat_total": F.when(n > 1, duration).otherwise(F.lit(0.0)), "fwd_iat_std": mean * 0.5,
        "flow_bytes/s": F.when(total > 0, total / duration).otherwise(F.lit(0.0)),
        "hot": flag(total > 10000), "num_file_creations": flag((total > 0) & (dst_bytes > src_bytes * 10)),
    }


def live_flow_record(packets: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """The 64-field record that feeds the flow model, from packets and their running flow."""
    state = P.connection_flag_rules(F.col("tcp_flags"), P.is_tcp())
    base = running_flow(packets, cuts=cuts).withColumns({
        "_src_bytes": payload_bytes(), "_state": state, "_sport": P.select_port(F.col("sport")), "_dport": P.select_port(F.col("dport"))})
    dport, length = F.col("_dport"), F.greatest(F.lit(0), F.col("length"))
    rates = flow_rates(F.col("_src_bytes"), F.lit(0), F.col("flow_duration"), F.col("flow_packets"))
    bits = {n: flag(P.is_tcp() & P.has_bit(F.col("tcp_flags"), n.upper())) for n in ("syn", "ack", "fin", "rst", "psh", "urg")}
    window = _zero_unless(P.is_tcp(), F.col("tcp_window"))
    zero = lambda *names: [F.lit(0).alias(n) for n in names]
    one = lambda *names: [F.lit(1).alias(n) for n in names]
    rate = lambda name: rates[name].alias(name)
    return base.select(
        "pkt_id", rate("duration"), P.protocol_code(P.protocol_text(F.col("proto"))).alias("protocol_type"),
        dport.alias("service"), F.col("_state").alias("flag"), F.col("_src_bytes").alias("src_bytes"), F.lit(0).alias("dst_bytes"),
        P.land_hosts_and_ports(F.col("src_ip"), F.col("dst_ip"), F.col("_sport"), dport).alias("land"),
        *zero("wrong_fragment", "urgent"), rate("hot"), P.login_port(dport).alias("num_failed_logins"),
        P.logged_in(F.col("tcp_flags"), P.is_tcp()).alias("logged_in"),
        *zero("num_compromised", "root_shell", "su_attempted", "num_root"), rate("num_file_creations"),
        *zero("num_shells", "num_access_files", "num_outbound_cmds"),
        P.host_ttl(F.col("ttl")).alias("is_host_login"), P.guest_ttl(F.col("ttl")).alias("is_guest_login"),
        *one("count", "srv_count", "dst_host_count", "dst_host_srv_count"),
        rate("flow_duration"), rate("fwd_packets/s"), F.lit(0.0).alias("bwd_packets/s"),
        *[length.alias(n) for n in ("packet_length", "min_packet_length", "max_packet_length")],
        rate("fwd_iat_total"), rate("fwd_iat_mean"), rate("fwd_iat_std"), window.alias("init_win_bytes_forward"),
        P.min_segment(window).alias("min_seg_size_forward"), rate("flow_bytes/s"), rate("flow_packets/s"),
        P.privileged_port(dport).alias("is_privileged_port"), P.common_service_port(dport).alias("is_common_port"),
        *[c.alias(f"tcp_flag_{n}") for n, c in bits.items()],
        *one_hot(F.col("_state"), vocab.FLAG_COLUMNS_69, "flag"),
        F.col("_sport").alias("sport"), dport.alias("dport"), "ttl", "src_ip", "dst_ip", F.col("ts_s").alias("timestamp"))


def align_features(df: DataFrame, expected: list[str], keep: list[str] | None = None) -> DataFrame:
    """The expected columns in order: missing ones are 0, nulls and NaN become 0. Columns to
    ``keep`` that are not among them come first, unchanged."""
    types = dict(df.dtypes)

    def aligned(name: str) -> Column:
        if name not in types:
            return F.lit(0.0).alias(name)
        value = F.col(name).cast("double")
        if types[name] in ("double", "float"):
            value = F.nanvl(value, F.lit(0.0))
        return F.coalesce(value, F.lit(0.0)).alias(name)

    return df.select(*[k for k in keep or [] if k not in expected], *[aligned(n) for n in expected])
