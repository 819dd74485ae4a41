"""Label names, alert wording and the gates between a prediction and an alert."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom import vocab
from packetloom.functions.columns import lookup
from packetloom.functions.packets import is_common_port

POSTGRES = "28"


def flow_class_name(label: Column) -> Column:
    """Name of a numeric class, ``Unknown_Attack_n`` outside the table; other text passes."""
    text = label.cast("string")
    number = F.when(text.rlike(r"^-?\d+$"), text.try_cast("int"))
    named = lookup(number, vocab.FLOW_CLASSES, F.concat(F.lit("Unknown_Attack_"), text))
    return F.when(number.isNotNull(), named).otherwise(text)


def kdd_class_name(label: Column) -> Column:
    """Name of a connection-model class, the number as text outside the table."""
    return lookup(label.cast("int"), dict(enumerate(vocab.KDD_CLASSES)), label.cast("string"))


def severity_bucket(severity: Column) -> Column:
    """Severity in 1..4; missing or 0 counts as 3."""
    given = F.coalesce(F.when(severity != 0, severity), F.lit(3))
    return F.greatest(F.lit(1), F.least(F.lit(4), given))


def severity_text(severity: Column) -> Column:
    return lookup(severity, vocab.SEVERITY_TEXT, F.lit("Info"))


def severity_class(severity: Column) -> Column:
    return lookup(severity, vocab.SEVERITY_CLASS, F.lit("alert-low"))


def alert_category(signature: Column, category: Column, severity: Column) -> Column:
    """Attack type by the first keyword in signature or category; severity 1-2 is suspicious."""
    sig, cat = F.lower(F.coalesce(signature, F.lit(""))), F.lower(F.coalesce(category, F.lit("")))
    chain = None
    for in_signature, in_category, name in vocab.ALERT_CATEGORIES:
        hit = sig.contains(in_signature) | cat.contains(in_category)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.when(severity <= 2, "Suspicious Activity")


def benign_rule(sport: Column, dport: Column, packet_length: Column | None = None, proto: Column | None = None) -> Column:
    """True for traffic taken as benign: a safe port on either side, a packet under 100 bytes, or
    ICMP. Length and protocol count only where given."""
    rule = sport.isin(vocab.SAFE_PORTS) | dport.isin(vocab.SAFE_PORTS)
    if packet_length is not None:
        rule = rule | (packet_length < 100)
    if proto is not None:
        rule = rule | proto.isin(1, 58)
    return rule


def common_service_whitelist(sport: Column, dport: Column, proto: Column) -> Column:
    """True for tcp/udp packets on a common port where one side is web, DNS or SSH."""
    either = lambda f: f(sport) | f(dport)
    return (
        either(is_common_port) & proto.isin(6, 17)
        & either(lambda p: p.isin(vocab.LOW_CONFIDENCE_PORTS))
    )


def prediction_gate(label: Column, confidence: Column, sport: Column, dport: Column, proto: Column,
                    packet_length: Column | None = None) -> Column:
    """Label after the scoring gates: the whitelists and the confidence limits turn it benign."""
    text = F.lower(label.cast("string"))
    on_common = sport.isin(vocab.LOW_CONFIDENCE_PORTS) | dport.isin(vocab.LOW_CONFIDENCE_PORTS)
    low = F.when(text == POSTGRES, 0.95).otherwise(0.7)
    return (
        F.when(common_service_whitelist(sport, dport, proto), "benign_common_port")
        .when(benign_rule(sport, dport, packet_length, proto) & (confidence < 0.8) & on_common, "benign_whitelisted")
        .when(confidence < low, "benign_low_confidence")
        .when(text.contains("postgres") & (confidence < 0.95), "benign_low_confidence_db")
        .otherwise(label.cast("string"))
    )


def is_benign_prediction(label: Column, sport: Column, dport: Column) -> Column:
    """True where the label names no attack or the ports are safe."""
    return F.lower(label.cast("string")).isin(vocab.BENIGN_LABELS) | benign_rule(sport, dport)


def is_attack(label: Column, confidence: Column, sport: Column, dport: Column) -> Column:
    return ~is_benign_prediction(label, sport, dport) & (confidence > 0.7)


def alert_gate(label: Column, confidence: Column, sport: Column, dport: Column) -> Column:
    """Outcome of the last gate: ``benign``, ``below_threshold`` or ``alert``."""
    is_postgres = label.cast("string") == POSTGRES
    off_port = is_postgres & (dport != 5432) & ~dport.between(3306, 3400)
    limit = F.when(is_postgres, 0.98).otherwise(0.85)
    return (
        F.when(is_benign_prediction(label, sport, dport) | off_port, "benign")
        .when(confidence < limit, "below_threshold")
        .otherwise("alert")
    )


def confidence_band(confidence: Column) -> Column:
    """Colour band; the lowest one can never follow the first and is kept as published."""
    return F.when(confidence < 0.9, "medium").when(confidence < 0.85, "low").otherwise("high")


def load_band(pps: Column) -> Column:
    return F.when(pps > 5000, "very_high").when(pps > 1000, "high").otherwise("normal")
