"""Packet header functions: protocol, service, TCP flags, ports, TTL, flow identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom import vocab
from packetloom.functions.columns import flag, lookup

TCP, UDP, ICMP = 6, 17, 1


def is_tcp() -> Column:
    return F.col("proto") == TCP


def is_udp() -> Column:
    return F.col("proto") == UDP


def has_bit(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(vocab.TCP_BITS[name]) != 0


def flag_bits(flags: Column, is_tcp: Column) -> list[Column]:
    """Eight 0/1 columns ``tcp_flag_X``; 0 for other protocols."""
    return [flag(is_tcp & has_bit(flags, name)).alias(f"tcp_flag_{name}") for name in vocab.TCP_BITS]


def protocol_text(proto: Column) -> Column:
    return F.when(proto == TCP, "tcp").when(proto == UDP, "udp").when(proto == ICMP, "icmp").otherwise("other")


def protocol_name(proto: Column, ip_version: Column | None = None) -> Column:
    """Display name by IP version, ``Proto-n`` for other numbers."""
    other = F.concat(F.lit("Proto-"), proto.cast("string"))
    v4 = F.when(proto == TCP, "TCP").when(proto == UDP, "UDP").when(proto == ICMP, "ICMP").otherwise(other)
    if ip_version is None:
        return v4
    v6 = F.when(proto == TCP, "TCPv6").when(proto == UDP, "UDPv6").when(proto == 58, "ICMPv6").otherwise(other)
    return F.when(ip_version == 6, v6).otherwise(v4)


def protocol_code(text: Column) -> Column:
    """Model code of a protocol text or number: tcp 0, udp 1, icmp 2, anything else 0."""
    low = F.lower(text)
    return F.when(low.isin("udp", "udp6", "17"), 1).when(low.isin("icmp", "icmp6", "1"), 2).otherwise(0)


def service_name(proto: Column, dport: Column, table: dict[int, str], registered: bool = True) -> Column:
    """Service of the destination port: fixed table, registered names, else ``other``."""
    names = {**(vocab.REGISTERED_SERVICES if registered else {}), **table}
    return F.when(proto.isin(TCP, UDP), lookup(dport, names, F.lit(vocab.DEFAULT_SERVICE))).otherwise(
        vocab.DEFAULT_SERVICE)


def flow_service(proto: Column, dport: Column) -> Column:
    """Service noted in a flow: well-known TCP ports only, ``port_n`` where unnamed."""
    named = lookup(dport, vocab.FLOW_SERVICES, F.concat(F.lit("port_"), dport.cast("string")))
    return F.when((proto == TCP) & (dport < 1024), named)


def connection_flag_exact(flags: Column, is_tcp: Column) -> Column:
    return F.when(is_tcp, lookup(flags, vocab.EXACT_FLAGS, F.lit("OTH"))).otherwise("OTH")


def connection_flag_rules(flags: Column, is_tcp: Column) -> Column:
    """Connection flag from single bits; the first rule that holds wins."""
    syn, ack, fin, rst = (is_tcp & has_bit(flags, n) for n in ("SYN", "ACK", "FIN", "RST"))
    return F.when(syn & ack, "SF").when(syn, "S0").when(fin & ack, "SF").when(rst, "RSTO").when(fin, "SF").otherwise("OTH")


def logged_in(flags: Column, is_tcp: Column) -> Column:
    return flag(is_tcp & has_bit(flags, "SYN") & has_bit(flags, "ACK"))


def tcp_anomaly(flags: Column, window: Column, is_tcp: Column) -> Column:
    """First TCP anomaly of a packet, null if none."""
    syn, ack, fin, rst = (has_bit(flags, n) for n in ("SYN", "ACK", "FIN", "RST"))
    return (
        F.when(is_tcp & syn & ack & fin, "TCP_ANOMALY: SYN-ACK-FIN flags set")
        .when(is_tcp & syn & rst, "TCP_ANOMALY: SYN-RST flags set")
        .when(is_tcp & (window == 0) & ~ack, "TCP_ANOMALY: Zero window without ACK")
    )


def land_hosts(src: Column, dst: Column) -> Column:
    return flag(src == dst)


def land_hosts_and_ports(src: Column, dst: Column, sport: Column, dport: Column) -> Column:
    return flag((src == dst) & (sport == dport))


def select_port(*candidates: Column) -> Column:
    """First present candidate as an integer in 0..65535; 0 when none can be read."""
    present = F.coalesce(*[c.cast("string") for c in candidates], F.lit("0"))
    return F.greatest(F.lit(0), F.least(F.lit(65535), F.coalesce(present.try_cast("int"), F.lit(0))))


def privileged_port(dport: Column) -> Column:
    return flag((dport > 0) & (dport < 1024))


def login_port(dport: Column) -> Column:
    return flag((dport > 0) & (dport < 1024) & dport.isin(vocab.LOGIN_PORTS))


def common_service_port(dport: Column) -> Column:
    privileged = (dport > 0) & (dport < 1024)
    return flag(privileged & ~dport.isin(vocab.LOGIN_PORTS) & dport.isin(vocab.COMMON_SERVICE_PORTS))


def min_segment(window: Column) -> Column:
    return F.when(window > 0, F.least(window, F.lit(1460))).otherwise(536)


def host_ttl(ttl: Column) -> Column:
    return flag(ttl <= 64)


def guest_ttl(ttl: Column) -> Column:
    return flag((ttl > 64) & (ttl <= 128))


def is_common_port(port: Column) -> Column:
    return port.isin(vocab.COMMON_PORTS)


def is_whitelisted_port(port: Column) -> Column:
    return port.isin(vocab.WHITELISTED_PORTS)


def flow_id(src: Column, dst: Column, proto: Column, sport: Column, dport: Column) -> Column:
    return F.concat_ws("-", src, dst, proto.cast("string"), sport.cast("string"), dport.cast("string"))


def ipv4_number(ip: Column) -> Column:
    """IPv4 text as a bigint; null for anything else."""
    part = F.split(ip, r"\.")
    number = (
        part[0].try_cast("bigint") * 16777216 + part[1].try_cast("bigint") * 65536
        + part[2].try_cast("bigint") * 256 + part[3].try_cast("bigint")
    )
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), number)
