"""One named query per operator: (spark, sf_dir) -> DataFrame over the whole fixture tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom import vocab
from packetloom.fixtures import table, view
from packetloom.functions import packets as P
from packetloom.functions import payload as B
from packetloom.functions import verdicts as V
from packetloom.operators import (
    balance, cleaning, detect, encoding, evaluate, features, flows, fusion, greedy, lookups, neighbours, profiling, rates,
    sampling, scans, traffic,
)
from packetloom.session import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DAY = 86_400.0
CIC_ID = ["l_orderkey", "l_linenumber"]


def query(*views: str, name: str | None = None):
    """Register a query; the named views are handed over as DataFrames."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*[view(spark, sf_dir, v) for v in views])

        QUERIES[name or fn.__name__] = run
        return fn

    return wrap


# --- detectors ---------------------------------------------------------------------------

@query("packets")
def scan_classifier(packets):
    return scans.classify_scans(packets).drop("ts_s")


@query("packets")
def horizontal_scan_60s(packets):
    return scans.horizontal_scans(packets).drop("ts_s")


@query("packets")
def vertical_scan_60s(packets):
    return scans.vertical_scans(packets).drop("ts_s")


@query("packets")
def flood_rate_10s(packets):
    return rates.flood_rate(packets, threshold=3.0).drop("ts_s")


@query("packets")
def flood_rate_per_target(packets):
    return rates.flood_rate(packets, threshold=0.5, per_target=True).drop("ts_s")


@query("packets")
def flood_alerts(packets):
    return rates.flood_alerts(packets, threshold=3.0).select("pkt_id", "alert")


@query("packets")
def throughput_2s(packets):
    dropped = P.is_common_port(F.col("sport")) | P.is_common_port(F.col("dport"))
    attack = P.tcp_anomaly(F.col("tcp_flags"), F.col("tcp_window"), P.is_tcp()).isNotNull()
    return rates.throughput(packets, dropped, attack)


@query("predictions_multi", "packets")
def predictions_30s(predictions, packets):
    return rates.prediction_counts(predictions.join(packets.select("pkt_id", "ts_s"), "pkt_id"), "predicted")


@query("packets")
def tcp_anomalies(packets):
    found = packets.select("pkt_id", P.tcp_anomaly(F.col("tcp_flags"), F.col("tcp_window"), P.is_tcp()).alias("anomaly"))
    return found.where("anomaly is not null")


@query("packets")
def conn_flag_exact(packets):
    return packets.select("pkt_id", P.connection_flag_exact(F.col("tcp_flags"), P.is_tcp()).alias("flag"))


@query("packets")
def conn_flag_rules(packets):
    return packets.select("pkt_id", P.connection_flag_rules(F.col("tcp_flags"), P.is_tcp()).alias("flag"),
                          P.logged_in(F.col("tcp_flags"), P.is_tcp()).alias("logged_in"))


@query("packets")
def flag_bits(packets):
    return packets.select("pkt_id", *P.flag_bits(F.col("tcp_flags"), P.is_tcp()))


@query("packets")
def detections(packets):
    return detect.detections(packets, flood_threshold=3.0)


@query("packets", "predictions_multi")
def detections_with_model(packets, predictions):
    return detect.detections(packets, predictions, flood_threshold=3.0)


@query("packets")
def dedupe_detections(packets):
    """Distinct detection classes per packet as one ordered text."""
    hits = F.array(B.http_class(F.col("payload")), B.dns_class(F.col("dns_query")), B.http_class(F.lower("payload")),
                   P.tcp_anomaly(F.col("tcp_flags"), F.col("tcp_window"), P.is_tcp()))
    unique = F.array_sort(F.array_distinct(F.array_compact(hits)))
    return packets.select("pkt_id", F.array_join(unique, "|").alias("detections"), F.size(unique).alias("n"))


@query("packets")
def decision_chain(packets):
    return detect.decision_chain(packets)


@query("packets")
def decision_cache(packets):
    judged = packets.select(*flows.FIVE_TUPLE, F.when(
        P.is_common_port(F.col("sport")) | P.is_common_port(F.col("dport")), "benign").otherwise("malicious").alias("decision"))
    return lookups.drop_decided(packets, judged, flows.FIVE_TUPLE).select("pkt_id", *flows.FIVE_TUPLE)


# --- payload -----------------------------------------------------------------------------

@query("packets")
def http_payload_class(packets):
    return packets.select("pkt_id", B.http_class(F.col("payload")).alias("http_class")).where("http_class is not null")


@query("documents")
def http_payload_documents(documents):
    return documents.select("doc_id", B.http_class(F.col("text")).alias("http_class"))


@query("pages")
def http_payload_pages(pages):
    return pages.select("page_id", B.http_class(F.col("html")).alias("http_class"))


@query("packets")
def dns_class(packets):
    return packets.select("pkt_id", B.dns_class(F.col("dns_query")).alias("dns_class")).where("dns_class is not null")


@query("pages")
def dns_class_hosts(pages):
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    return pages.select("page_id", host.alias("host"), B.dns_class(host).alias("dns_class"))


@query("packets")
def payload_entropy(packets):
    return packets.select("pkt_id", F.round(B.text_entropy(F.col("payload")), 9).alias("entropy"))


@query("documents")
def payload_entropy_documents(documents):
    return documents.select("doc_id", F.round(B.byte_entropy(F.encode("text", "UTF-8")), 9).alias("entropy"))


@query("packets")
def printable_ratio(packets):
    return packets.select("pkt_id", F.round(B.printable_ratio(F.col("payload")), 9).alias("ratio"))


@query("documents")
def printable_ratio_documents(documents):
    return documents.select("doc_id", F.round(B.printable_ratio(F.col("text")), 9).alias("ratio"))


@query("documents")
def shellcode_test(documents):
    """Whole texts as payloads; every fifth carries a no-op run, every seventh the same bytes
    shifted by half a byte, which must not match."""
    text = F.encode("text", "UTF-8")
    run = F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("90" * 8))).when(
        F.col("doc_id") % 7 == 0, F.unhex(F.lit("A" + "90" * 8 + "5"))).otherwise(F.unhex(F.lit("")))
    data = documents.select("doc_id", F.concat(text, run).alias("data"))
    return data.select("doc_id", B.is_shellcode(F.col("data"), B.byte_entropy("data")).alias("shellcode"))


# --- flows -------------------------------------------------------------------------------

@query("packets")
def bidirectional_flows(packets):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return flows.bidirectional_flows(packets).select(
        *flows.FLOW_KEY, "first_seen", "last_seen", "packets", "bytes", "min_length", "max_length", "length_squares",
        "iat_total", "iat_max", "is_reverse", text("src_ports"), text("dst_ports"), text("flag_values"), text("services"))


@query("packets")
def flow_totals(packets):
    return flows.flow_totals(flows.flow_sessions(flows.bidirectional(packets), flows.FLOW_KEY))


@query("packets")
def connections(packets):
    return flows.connections(packets)


@query("packets")
def flow_flag_counts(packets):
    return flows.flow_flag_counts(packets).withColumn("avg_packet_size", F.round("avg_packet_size", 6))


@query("packets")
def flow_running(packets):
    return flows.running_flow(packets).select("pkt_id", "flow_packets", "flow_bytes", "flow_duration",
                                              F.round("packet_rate", 9).alias("packet_rate"),
                                              F.round("packets_per_second", 6).alias("packets_per_second"))


@query("packets")
def flow_iat(packets):
    return flows.running_flow(packets).select("pkt_id", "iat", F.coalesce("iat", F.lit(0.0)).alias("iat_or_zero"))


@query("packets")
def flow_sessions(packets):
    return flows.flow_sessions(packets)


@query("packets")
def flow_reset_60s(packets):
    """Per source, whose traffic is dense enough to hit the limit."""
    return greedy.flow_reset(packets, ["src_ip"]).select("pkt_id", "src_ip", "flow_packet_count", "flow_duration",
                                                       F.round("packet_rate", 9).alias("packet_rate"))


@query("packets")
def rate_limit(packets):
    return greedy.rate_limit(packets, ["proto", "src_ip"], "ts_s", "pkt_id", max_events=3, window=20.0).select("pkt_id", "admitted")


@query("packets")
def kdd_counts_faithful(packets):
    scanned = flows.running_flow(packets)
    return scanned.select("pkt_id", *[F.col("flow_packets").alias(n) for n in vocab.COUNT_FIELDS_69],
                          *[F.lit(0.0).alias(n) for n in vocab.ZERO_RATES_69], *[F.lit(1.0).alias(n) for n in vocab.ONE_RATES_69])


@query("packets")
def kdd_counts_2s(packets):
    rated = ["serror_rate", "rerror_rate", "srv_serror_rate", "srv_rerror_rate", "same_srv_rate"]
    return rates.host_service_counts(packets).select("pkt_id", "count", "srv_count", *[F.round(c, 9).alias(c) for c in rated])


# --- feature records ---------------------------------------------------------------------

def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(f"`{c}`", digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


@query("packets")
def features_47(packets):
    return _rounded(features.features_47(packets, entropy=False, reset=None))


@query("packets")
def features_47_reset(packets):
    return _rounded(features.features_47(packets))


@query("packets")
def features_69(packets):
    return _rounded(features.features_69(packets))


@query("packets")
def cic_live_features(packets):
    return _rounded(features.live_flow_record(packets))


@query("packets")
def header_features(packets):
    return _rounded(features.header_features(packets))


@query("mixed_packets")
def labelled_capture(packets):
    return features.labelled_capture(packets, "attack", 1000).select(
        "pkt_id", "flow_id", "label", "count", "duration", "service_http", "flag_S0")


@query("cic_flows")
def align_features(flows_df):
    return features.align_features(flows_df.withColumn("row_id", F.xxhash64(*CIC_ID)).select("flow_duration", "tot_byts", "idle_mean"),
                                   ["tot_byts", "fwd_seg_size_min", "idle_mean", "flow_duration"])


@query("packets")
def protocol_service(packets):
    proto, dport = F.col("proto"), F.col("dport")
    return packets.select("pkt_id", P.protocol_text(proto).alias("protocol"), P.protocol_name(proto).alias("protocol_name"),
                          P.protocol_code(P.protocol_text(proto)).alias("protocol_code"),
                          P.service_name(proto, dport, vocab.SERVICES_47).alias("service"))


@query("packets")
def land_test(packets):
    a, b = F.col("src_ip"), F.col("dst_ip")
    return packets.select("pkt_id", P.land_hosts(a, b).alias("land_hosts"),
                          P.land_hosts_and_ports(a, b, F.col("sport"), F.col("dport")).alias("land_ports"))


@query("packets")
def flow_rates(packets):
    sums = packets.groupBy(*flows.FIVE_TUPLE).agg(
        F.sum(features.payload_bytes()).alias("src_bytes"), F.sum(F.when(F.col("pkt_id") % 7 == 0, F.col("length") * 40).otherwise(0)).alias("dst_bytes"),
        (F.max("ts_s") - F.min("ts_s")).alias("span"), F.count(F.lit(1)).alias("n"))
    rated = features.flow_rates(F.col("src_bytes"), F.col("dst_bytes"), F.col("span"), F.col("n"))
    return _rounded(sums.select(*flows.FIVE_TUPLE, *[c.alias(n.replace("/", "_per_")) for n, c in rated.items()]))


@query("packets")
def port_window_flags(packets):
    d = F.col("dport")
    return packets.select("pkt_id", P.min_segment(F.col("tcp_window")).alias("min_seg"), P.privileged_port(d).alias("privileged"),
                          P.login_port(d).alias("login"), P.common_service_port(d).alias("common"))


@query("packets")
def ttl_fingerprint(packets):
    return packets.select("pkt_id", P.host_ttl(F.col("ttl")).alias("host"), P.guest_ttl(F.col("ttl")).alias("guest"))


@query("packets")
def flow_id_text(packets):
    return packets.select("pkt_id", P.flow_id(*[F.col(c) for c in flows.FIVE_TUPLE]).alias("flow_id"))


@query("events")
def time_text(events):
    ts = F.col("ts")
    return events.select("event_id", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("second_text"), F.date_format(ts, "HH:mm:ss.SSS").alias("clock_text"),
                         F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("iso_text"), F.unix_micros(ts.cast("timestamp")).alias("epoch_us"))


@query("events")
def json_props(events):
    k = F.from_json("props", "k bigint")["k"]
    return events.select("event_id", k.alias("k"), F.get_json_object("props", "$.k").alias("k_text"), F.get_json_object("props", "$.none").alias("absent"))


@query("cic_flows")
def string_basics(df):
    label = F.col("label")
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(
        "label", "n", F.trim(label).alias("stripped"), F.upper(F.trim(label)).alias("upper_text"), F.lower(label).alias("lower_text"),
        F.replace(label, F.lit(" "), F.lit("_")).alias("underscored"), F.startswith(label, F.lit("DoS")).alias("is_dos"),
        F.split(F.trim(label), " ")[0].alias("first_word"), F.contains(F.lower(label), F.lit("scan")).alias("has_scan"),
        F.coalesce(label.rlike(r"^\d+$"), F.lit(False)).alias("is_digit"))


@query("packets")
def math_basics(packets):
    return packets.select(
        "pkt_id", F.round(F.log2(F.col("length").cast("double")), 9).alias("log_length"),
        F.greatest(F.lit(100), F.least(F.lit(1000), F.col("length"))).alias("clamped"), F.bround(F.col("length") / 7, 2).alias("seventh"),
        F.col("tcp_flags").bitwiseAND(18).alias("syn_ack_bits"),
        F.size(F.array_distinct(F.array("sport", "dport", "tcp_window"))).alias("distinct_numbers"),
        F.aggregate(F.zip_with(F.array("sport", "length"), F.array("dport", "ttl"), lambda a, b: b - a), F.lit(0), lambda acc, x: acc + x).alias("zip_difference"))


# --- alerts and fusion -------------------------------------------------------------------

@query("eve")
def alert_rows(eve):
    return fusion.alert_rows(eve).drop("ts_s")


@query("eve")
def flow_promote(eve):
    promoted = fusion.promote_flows(fusion.parse_events(eve), promote_all=True)
    return promoted.where("e.event_type = 'flow'").select("event_no", "e.alert.signature", "e.alert.severity", "e.alert.signature_id")


@query("eve")
def alert_normalise(eve):
    return fusion.read_alerts(eve).drop("ts_s")


@query("packets", "eve")
def alert_fusion(packets, eve):
    matched = fusion.match_alerts(packets, fusion.read_alerts(eve))
    return packets.select("pkt_id").join(matched, "pkt_id", "left")


@query("packets", "eve")
def packet_events(packets, eve):
    return fusion.packet_events(packets, fusion.read_alerts(eve))


@query("packets")
def cidr_whitelist(packets):
    flagged = lookups.in_networks(packets, {"src_in": "src_ip", "dst_in": "dst_ip"}, ["10.0.0.0/29", "10.0.0.12/32", "::1/128"])
    return flagged.select("pkt_id", "src_in", "dst_in")


@query("packets")
def cidr_join(packets):
    """Networks derived from the traffic: one /30 per distinct destination block."""
    number = P.ipv4_number(F.col("dst_ip"))
    networks = packets.select((F.floor(number / 4) * 4).alias("lo")).distinct().select(
        "lo", (F.col("lo") + 3).alias("hi"), F.concat(F.lit("net-"), F.col("lo").cast("string")).alias("network"))
    return lookups.network_join(packets.select("pkt_id", "src_ip"), "src_ip", networks)


@query("eve")
def alert_category(eve):
    return traffic.describe_alerts(fusion.read_alerts(eve, promote_all=True))


@query("eve")
def alerts_by_severity(eve):
    return traffic.alerts_by_severity(fusion.read_alerts(eve, promote_all=True))


@query("packets", "eve")
def dashboard_snapshot(packets, eve):
    return traffic.dashboard_snapshot(fusion.packet_events(packets, fusion.read_alerts(eve)))


@query("packets")
def detection_log(packets):
    """Log line per detection."""
    found = detect.detections(packets, flood_threshold=3.0).join(packets, "pkt_id")
    return found.select("pkt_id", F.format_string(
        "Detected attacks from %s to %s: %s", "src_ip", "dst_ip", "detection").alias("line"))


@query("packets")
def protocol_counts(packets):
    return traffic.protocol_counts(packets.select(P.protocol_name(F.col("proto")).alias("protocol")))


@query("packets")
def top_sources(packets):
    return traffic.top_endpoints(packets, "src_ip", "sport")


@query("packets")
def top_destinations(packets):
    return traffic.top_endpoints(packets, "dst_ip", "dport")


@query("packets")
def recent_packets(packets):
    return traffic.recent(packets, 100, "pkt_id", "src_ip", "dst_ip", "length")


@query("packets")
def session_totals(packets):
    totals = traffic.session_totals(packets, P.is_common_port(F.col("sport")) | P.is_common_port(F.col("dport")))
    return _rounded(totals)


@query("predictions_multi", "packets")
def latest_attack(predictions, packets):
    timed = predictions.where(F.col("predicted") != 0).join(packets.select("pkt_id", "ts_s", "src_ip", "dst_ip"), "pkt_id")
    attacks = timed.select("pkt_id", "ts_s", V.flow_class_name(F.col("predicted")).alias("attack_name"),
                           F.concat_ws(":", "src_ip", F.col("sport").cast("string")).alias("src"),
                           F.concat_ws(":", "dst_ip", F.col("dport").cast("string")).alias("dst"))
    return traffic.latest_attack(attacks, packets)


@query("predictions_multi")
def detection_summary(predictions):
    return traffic.detection_summary(predictions, V.flow_class_name(F.col("predicted")))


# --- labels and gates --------------------------------------------------------------------

@query("predictions_multi")
def attack_names(predictions):
    shifted = (F.col("predicted") + F.when(F.col("pkt_id") % 50 == 0, 10).otherwise(0)).cast("string")
    label = F.when(F.col("pkt_id") % 61 == 0, "port scan").otherwise(shifted)
    return predictions.select("pkt_id", V.flow_class_name(label).alias("attack_name"))


@query("predictions_multi")
def kdd_names(predictions):
    return predictions.select("pkt_id", V.kdd_class_name(F.col("predicted")).alias("kdd_name"))


@query("predictions_multi")
def prediction_gate(predictions):
    return predictions.select("pkt_id", V.prediction_gate(
        F.col("predicted"), F.col("confidence"), F.col("sport"), F.col("dport"), F.col("proto")).alias("outcome"))


@query("predictions_multi")
def alert_gate(predictions):
    c = [F.col(x) for x in ("predicted", "confidence", "sport", "dport")]
    return predictions.select("pkt_id", V.is_attack(*c).alias("is_attack"), V.alert_gate(*c).alias("outcome"), V.confidence_band(c[1]).alias("band"))


@query("predictions_multi")
def outcome_counters(predictions):
    c = [F.col(x) for x in ("predicted", "confidence", "sport", "dport")]
    return predictions.agg(F.count_if(V.is_attack(*c)).alias("malicious"), F.count_if(V.is_benign_prediction(c[0], c[2], c[3])).alias("benign"),
                           F.count_if(F.col("confidence") < 0.7).alias("unsure"))


@query("packets")
def benign_rule(packets):
    return packets.select("pkt_id", V.benign_rule(F.col("sport"), F.col("dport"), F.col("length"), F.col("proto")).alias("benign"),
                          V.common_service_whitelist(F.col("sport"), F.col("dport"), F.col("proto")).alias("whitelisted"))


@query("packets")
def port_whitelist(packets):
    return packets.select("pkt_id", P.is_whitelisted_port(F.col("dport")).alias("whitelisted"), P.is_common_port(F.col("dport")).alias("common"),
                          (P.is_common_port(F.col("sport")) | P.is_common_port(F.col("dport"))).alias("fast_path"))


@query("packets")
def port_select(packets):
    """Four candidate names per side, the later ones filled only for some rows."""
    n = F.col("pkt_id")
    sport = P.select_port(F.when(n % 3 == 0, F.col("sport")), F.when(n % 3 == 1, F.col("sport") * 100), F.when(n % 11 == 0, F.lit("none")))
    return packets.select("pkt_id", sport.alias("port"))


@query("mixed_packets")
def ip_only(packets):
    return packets.where(F.col("ip_version").isin(4, 6)).select("pkt_id", "ip_version", P.protocol_name(F.col("proto"), F.col("ip_version")).alias("protocol"))


@query("mixed_packets")
def capture_filter(packets):
    from packetloom.sources.tables import capture_filter as apply_filter

    return apply_filter(packets, "ip or ip6", "not port 22").select("pkt_id")


@query("packets")
def service_lookup(packets):
    """Service names through a dimension derived from the traffic's own ports."""
    dim = packets.select("dport").distinct().select("dport", P.service_name(F.lit(6), F.col("dport"), vocab.SERVICES_69).alias("service")).where("service <> 'other'")
    return lookups.dimension(packets, F.col("dport"), dim, "dport", "service", F.lit("other"), "service").select("pkt_id", "service")


# --- profiling and cleaning --------------------------------------------------------------

@query("cic_flows")
def label_distribution(df):
    return profiling.label_distribution(df, "label")


@query("cic_flows")
def label_distribution_cum(df):
    return profiling.distribution_with_shares(profiling.label_distribution(df, "label")).withColumn("cum_pct", F.round("cum_pct", 6))


@query("cic_flows")
def class_stats(df):
    return _rounded(profiling.class_stats(profiling.label_distribution(df, "label")))


@query("nslkdd")
def suggested_cap(df):
    return profiling.suggested_cap(profiling.label_distribution(df, "service"))


@query("cic_flows")
def safe_cap(df):
    return profiling.safe_cap(profiling.label_distribution(df, "label"))


@query("nslkdd")
def profile_summary(df):
    return _rounded(profiling.profile_summary(df, ["protocol_type", "service", "flag", "label"]))


@query("cic_flows")
def head_sorted(df):
    return profiling.label_distribution(df, "label").orderBy(F.desc("n"), "label").limit(3)


@query("cic_flows")
def label_only_scan(df):
    return profiling.label_distribution(df.select("label"), "label")


@query("cic_flows")
def header_clean(df):
    dirty = df.select(F.col("flow_duration").alias(" Flow Duration"), F.col("tot_byts").alias("Tot Byts "), F.col("label").alias(" Label"))
    return cleaning.clean_headers(dirty).groupBy("label").agg(F.sum("flow_duration").alias("flow_duration"), F.round(F.sum("tot_byts"), 2).alias("tot_byts"))


@query("cic_flows")
def inf_to_null(df):
    return cleaning.infinite_to_null(df).select(*CIC_ID, "tot_byts", "flow_byts_s", "idle_mean")


@query("cic_flows")
def clean_flows(df):
    return cleaning.clean_flows(df)


@query("cic_flows")
def median_impute(df):
    return cleaning.median_impute(df.select(*CIC_ID, "flow_duration", "flow_byts_s", "idle_mean"))


@query("cic_flows")
def numeric_coerce(df):
    return cleaning.coerce_numeric(df.select(*CIC_ID, "raw_num", "idle_mean"), ["raw_num", "idle_mean"])


@query("cic_flows")
def missing_counts(df):
    return cleaning.missing_counts(cleaning.infinite_to_null(df))


@query("cic_flows")
def duplicate_count(df):
    return cleaning.duplicate_count(df.select("flow_duration", "idle_mean", "label"))


@query("nslkdd")
def drop_columns(df):
    return cleaning.drop_columns(df)


@query("cic_flows")
def drop_constant(df):
    return cleaning.drop_constant(df)


@query("nslkdd")
def rare_services(df):
    return cleaning.collapse_rare(df, threshold=500).select("pkt_id", "service")


@query("nslkdd")
def one_hot_all(df):
    return encoding.one_hot_all(df.drop("num_outbound_cmds", "difficulty"))


@query("packets")
def one_hot_vocab(packets):
    from packetloom.functions.columns import one_hot

    # named first, so that a lookup runs once per row and not once per column
    named = packets.withColumns({
        "_service": P.service_name(F.col("proto"), F.col("dport"), vocab.SERVICES_69),
        "_flag": P.connection_flag_exact(F.col("tcp_flags"), P.is_tcp())})
    return named.select("pkt_id", *one_hot(P.protocol_text(F.col("proto")), vocab.PROTOCOLS_69, "protocol_type"),
                        *one_hot(F.col("_service"), vocab.SERVICE_COLUMNS_69, "service"), *one_hot(F.col("_flag"), vocab.FLAG_COLUMNS_69, "flag"))


@query("cic_flows")
def label_standard(df):
    return cleaning.standardise_labels(df).select(*CIC_ID, "flow_duration", "label")


@query("cic_flows")
def label_binary(df):
    return cleaning.standardise_labels(df, binary=True).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("cic_flows")
def typed_load(df):
    types = {"tinyint": ["raw_num"], "int": ["flow_duration"], "float": ["idle_mean"], "string": ["label"]}
    return cleaning.typed_load(df.select(*CIC_ID, "flow_duration", "idle_mean", "raw_num", "label"), types)


@query("packets")
def type_ranges(packets):
    return cleaning.column_types(packets.select("pkt_id", "ts_s", "proto", "sport", "dport", "length", "ttl", "tcp_flags", "tcp_window"))


@query("cic_flows")
def rename_columns(df):
    renamed = cleaning.rename_columns(df.select(*CIC_ID, F.col("flow_duration").alias("feature_0"), F.col("tot_byts").alias("feature_1"), "label"),
                                      {"feature_0": "duration_s", "1": "bytes_total"})
    return renamed


@query("cic_flows")
def min_class_filter(df):
    sized = df.withColumn("label", F.when(F.col("l_orderkey") % 1009 == 5, F.concat(F.lit("rare-"), F.col("l_orderkey").cast("string"))).otherwise(F.col("label")))
    return lookups.keep_classes(sized.where("label is not null"), "label", 4).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("cic_flows", "nslkdd")
def unseen_labels(flow_table, kdd):
    return lookups.unseen(flow_table.where("label is not null").select(F.lower(F.trim("label")).alias("label")), kdd, "label")


@query("packets", "cic_flows")
def feature_diff(packets, flow_table):
    """Ports seen as source but never as destination, and the union of both sets."""
    src, dst = packets.select(F.col("sport").alias("port")), packets.select(F.col("dport").alias("port"))
    only = src.distinct().join(dst, "port", "left_anti").select("port", F.lit("source only").alias("side"))
    return only.unionByName(src.union(dst).distinct().select("port", F.lit("either").alias("side")))


@query("packets", "cic_flows")
def union_by_name(packets, flow_table):
    a = packets.select(F.col("length").cast("double").alias("tot_byts"), F.col("proto").alias("protocol"))
    b = flow_table.select("tot_byts", "label")
    return a.unionByName(b, allowMissingColumns=True).groupBy("protocol", "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("tot_byts"), 2).alias("bytes"))


# --- encoding, scaling, preprocessing ----------------------------------------------------

@query("cic_flows")
def class_weights(df):
    return _rounded(encoding.class_weights(profiling.label_distribution(df, "label")), 9)


@query("cic_flows")
def weighted_rows(df):
    weights = encoding.class_weights(profiling.label_distribution(df, "label"))
    joined = encoding.with_weights(df, "label", weights)
    return joined.select(*CIC_ID, "label", F.round("weight", 9).alias("weight"))


@query("nslkdd")
def column_variance(df):
    return encoding.column_variance(df, ["src_bytes", "dst_bytes", "num_outbound_cmds", "difficulty"]).withColumn("variance", F.round("variance", 3))


@query("nslkdd")
def minmax_scale(df):
    scaled = encoding.minmax_scale(df.select("src_bytes", "dst_bytes", "num_outbound_cmds", "difficulty", "label", "pkt_id"))
    return _rounded(scaled, 9)


@query("cic_flows")
def label_encode(df):
    return encoding.encode_label(df.where("label is not null"), "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("cic_flows")
def preprocess_flows(df):
    from packetloom.plans.preprocess import preprocess_flow_table

    out, _ = preprocess_flow_table(df.where("label is not null"), label="label", select_features=True)
    return _rounded(out, 9)


@query("nslkdd")
def preprocess_kdd(df):
    from packetloom.plans.preprocess import preprocess_connection_table

    return _rounded(preprocess_connection_table(df, rare_threshold=500), 9)


# --- evaluation --------------------------------------------------------------------------

@query("predictions_multi")
def confusion_matrix(predictions):
    return _rounded(evaluate.confusion_matrix(predictions), 9)


@query("predictions_multi")
def macro_metrics(predictions):
    return _rounded(evaluate.macro_metrics(predictions), 9)


@query("predictions")
def classification_report(predictions):
    return _rounded(evaluate.classification_report(predictions), 9)


@query("predictions")
def roc_auc(predictions):
    return _rounded(evaluate.roc_auc(predictions), 9)


@query("predictions")
def roc_curve(predictions):
    return _rounded(evaluate.roc_curve(predictions).drop("area"), 9)


@query("predictions")
def pr_curve(predictions):
    return _rounded(evaluate.pr_curve(predictions).drop("rank"), 9)


@query("predictions")
def average_precision(predictions):
    return _rounded(evaluate.average_precision(predictions), 9)


def _threshold_models(predictions: DataFrame) -> DataFrame:
    """Metrics of four cut-offs on the score, as if they were four models."""
    results = None
    for cut in (0.2, 0.4, 0.6, 0.8):
        model = predictions.select("actual", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))
        one = evaluate.macro_metrics(model).withColumn("model_name", F.lit(f"cut_{cut}"))
        results = one if results is None else results.unionByName(one)
    return results


@query("predictions")
def leaderboard(predictions):
    return _rounded(evaluate.leaderboard(_threshold_models(predictions)), 9)


@query("predictions")
def model_comparison(predictions):
    return _rounded(evaluate.metric_ranks(_rounded(_threshold_models(predictions), 9)), 9)


@query("predictions_multi")
def majority_fallback(predictions):
    """Classes with no actual row below class 20 count as trained."""
    classes = predictions.where("actual < 20").select(F.col("actual").alias("class")).distinct()
    top = predictions.where("actual < 20").groupBy("actual").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("actual", F.struct("n", -F.col("actual"))))
    return evaluate.majority_fallback(predictions, classes, top.scalar()).select("pkt_id", "predicted")


# --- sampling and balancing --------------------------------------------------------------

@query("cic_flows")
def split_counts(df):
    parts = sampling.train_test(df.where("label is not null"), "label")
    return parts.groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n"))


@query("cic_flows")
def cap_counts(df):
    return sampling.cap_classes(df.where("label is not null"), "label", 1500).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("cic_flows")
def sample_counts(df):
    return sampling.sample_per_class(df, "label", n_samples=5000).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("cic_flows")
def sample_fraction_counts(df):
    return sampling.sample_per_class(df, "label", fraction=0.1).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("cic_flows")
def plain_sample_count(df):
    return sampling.sample_rows(df, n_samples=2500).agg(F.count(F.lit(1)).alias("n"))


def _uneven(embeddings: DataFrame) -> DataFrame:
    """Merge labels 0-5 into one class so that the others are minorities."""
    return embeddings.withColumn("label", F.when(F.col("label") < 6, 0).otherwise(F.col("label")))


@query("embeddings")
def smote_counts(embeddings):
    base = _uneven(embeddings)
    made = balance.smote(base)
    return base.select("label").unionAll(made.select("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("embeddings")
def adasyn_rows(embeddings):
    return balance.adasyn(_uneven(embeddings))


@query("cic_flows")
def smote_batch_faithful(df):
    return balance.duplicate_minorities(df.where("label is not null"), "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("embeddings")
def knn_neighbours(embeddings):
    found = neighbours.nearest(embeddings, embeddings, 5, within="label", exclude_self=True)
    return found.select("query_id", "neighbour_id", "rank", F.round("distance", 6).alias("distance"))


@query("embeddings")
def knn_classify(embeddings):
    """Every fourth row is classified from the rest."""
    is_test = F.col("vec_id") % 4 == 0
    return neighbours.knn_classify(embeddings.where(is_test), embeddings.where(~is_test), k=5)


@query("embeddings")
def knn_classify_weighted(embeddings):
    is_test = F.col("vec_id") % 4 == 0
    return neighbours.knn_classify(embeddings.where(is_test), embeddings.where(~is_test), k=7, weights="distance", metric="manhattan")


# --- models ------------------------------------------------------------------------------

def _flow_training(df: DataFrame, binary: bool = False):
    """Prepared flow table, split; the features of the fixture say little, which is fine here."""
    from packetloom.plans.preprocess import preprocess_flow_table

    labelled = cleaning.standardise_labels(df.where("label is not null"), binary=binary)
    prepared, fitted = preprocess_flow_table(labelled, "label", select_features=True)
    names = fitted.names()["processed_features"]
    # every pass of a fit reads the prepared rows: write them once
    parts = materialise(sampling.train_test(prepared, "label"), "prepared")
    return parts.where(~F.col("is_test")), parts.where("is_test"), names


def _metrics_of(df: DataFrame, name: str, binary: bool = False, **options) -> DataFrame:
    from packetloom.plans.training import train_all

    train, test, names = _flow_training(df, binary)
    return train_all([name], train, test, names, names, **options).drop("training_time")


@query("cic_flows")
def train_random_forest(df):
    return _metrics_of(df, "random_forest", sampling_method="duplicate")


@query("cic_flows")
def train_logistic_regression(df):
    return _metrics_of(df, "logistic_regression", maxIter=20)


@query("cic_flows")
def train_decision_tree(df):
    return _metrics_of(df, "decision_tree", maxDepth=5, weighted=True)


@query("cic_flows")
def train_boosted_binary(df):
    return _metrics_of(df, "xgboost", binary=True, maxIter=5, maxDepth=3)


@query("cic_flows")
def train_boosted_multiclass(df):
    return _metrics_of(df, "gradient_boosting", maxIter=3, maxDepth=3)


CLASS_RULE = "CASE WHEN proto = 1 THEN 0 WHEN proto = 17 THEN 1 WHEN dport < 100 THEN 2 ELSE 3 END"


@query("packets")
def boosted_classes(packets):
    """Boosted class trees learn a rule of two features from six sevenths of the packets; the rest is predicted.

    The model is fitted on one half of its rows and grown on the other.
    """
    from packetloom.operators.boosting import Settings, fit_boosted
    from packetloom.plans.training import grow_boosted

    names, settings = ["length", "dport", "proto", "ttl"], Settings(rounds=6, depth=3)
    rows = packets.withColumn("label", F.expr(CLASS_RULE))
    learnt, half = rows.where("pkt_id % 7 <> 0"), F.floor(F.col("pkt_id") / 10) % 2
    model = grow_boosted(fit_boosted(learnt.where(half == 0), names, "label", 4, settings), learnt.where(half == 1), settings)
    return model.transform(rows.where("pkt_id % 7 = 0").select("pkt_id", *names)).select("pkt_id", F.col("prediction").cast("int").alias("predicted"))


@query("cic_flows")
def train_tuned(df):
    """Random search over two draws with cross-validated macro F1."""
    from packetloom.plans.training import random_search, assemble

    train, _, names = _flow_training(df, binary=True)
    space = [{"maxDepth": 2, "minInstancesPerNode": 1}, {"maxDepth": 5, "minInstancesPerNode": 3}]
    best, value = random_search("decision_tree", assemble(train, names), 2, names, folds=3, space=space)
    return df.sparkSession.createDataFrame([(str(best), value)], "params string, f1_cv double")


@query("packets", "nslkdd")
def score_packets(packets, kdd):
    """Train on the connection records, score every packet, and apply the gates."""
    from packetloom.plans.training import gated, score, train_model

    records = features.features_69(packets, keep=["proto"])
    names = vocab.KDD_MODEL_COLUMNS
    labelled = materialise(encoding.encode_label(records.join(kdd.select("pkt_id", "label"), "pkt_id"), "label"), "records")
    trained = train_model("random_forest", labelled, labelled, names, ["pkt_id"], maxDepth=5)
    scored = score(records, trained.model, names, ["pkt_id", "sport", "dport", "proto"])
    return gated(scored, "sport", "dport", "proto").select("pkt_id", "predicted", "confidence", "outcome")


@query("packets", "nslkdd")
def top_probabilities(packets, kdd):
    from packetloom.plans.training import train_model

    names = ["src_bytes", "duration", "count"]
    labelled = materialise(encoding.encode_label(features.features_69(packets).join(kdd.select("pkt_id", "label"), "pkt_id"), "label"), "records")
    trained = train_model("random_forest", labelled, labelled, names, ["pkt_id"], maxDepth=4, numTrees=5)
    return evaluate.top_probabilities(trained.model.transform(labelled).select("pkt_id", "probability"), k=3).select("pkt_id", "rank", "class", "p")


@query("packets", "nslkdd")
def feature_importance(packets, kdd):
    from packetloom.plans.training import feature_importance as importance, train_model

    names = vocab.KDD_MODEL_COLUMNS
    labelled = materialise(encoding.encode_label(features.features_69(packets).join(kdd.select("pkt_id", "label"), "pkt_id"), "label"), "records")
    trained = train_model("decision_tree", labelled, labelled, names, ["pkt_id"], maxDepth=5)
    return importance(trained.model, names)


# --- files -------------------------------------------------------------------------------

@query("capture_files")
def file_labels(files):
    return files.select("pkt_id", "file_name", F.split("file_name", "_")[0].alias("label"))


@query("capture_files")
def prefix_join(files):
    prefixes = files.sparkSession.createDataFrame([(p, p) for p in vocab.CAPTURE_PREFIXES], "prefix string, label string")
    return lookups.prefix_labels(files, "file_name", prefixes).select("pkt_id", "file_name", "label")


def _scan_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packetloom.sources.tables import read_columns

    return read_columns(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"])


QUERIES["scan_projected"] = _scan_projected


def _scan_multi_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory with one CSV and one Parquet part of the packets, read as one table."""
    from packetloom.session import run_folder
    from packetloom.sources.tables import read_directory

    packets = view(spark, sf_dir, "packets")
    folder = run_folder(spark, "mixed")
    packets.where("proto = 6").select("pkt_id", "src_ip", "length", "tcp_flags").write.parquet(f"{folder}/tcp.parquet")
    packets.where("proto <> 6").select("pkt_id", "src_ip", F.col("length").alias(" Length ")).write.option("header", True).csv(f"{folder}/other.csv")
    both = read_directory(spark, folder)
    return both.select(F.col("pkt_id").cast("bigint").alias("pkt_id"), "src_ip", F.col("length").cast("int").alias("length"), "tcp_flags")


QUERIES["scan_multi_format"] = _scan_multi_format


def _table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet scan of every given table: rows per table, from the files' own counts."""
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    out = None
    for n in names:
        one = table(spark, sf_dir, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["scan_parquet"] = _table_counts


# --- streams: the same results from Structured Streaming jobs ----------------------------

def _append(transform):
    from packetloom.streaming.jobs import run_available

    return lambda stream, path, checkpoint: run_available(transform(stream()), path, checkpoint)


@query("packets")
def stream_throughput_2s(packets):
    from packetloom.streaming.jobs import throughput_stream
    from packetloom.streaming.replay import replay

    dropped = P.is_common_port(F.col("sport")) | P.is_common_port(F.col("dport"))
    attack = P.tcp_anomaly(F.col("tcp_flags"), F.col("tcp_window"), P.is_tcp()).isNotNull()
    return replay(packets, _append(lambda s: throughput_stream(s, dropped, attack)), close=True)


@query("packets")
def stream_flood_10s(packets):
    from packetloom.streaming.jobs import flood_stream
    from packetloom.streaming.replay import replay

    return replay(packets, _append(lambda s: flood_stream(s, 3.0)), close=True)


@query("packets")
def stream_flow_sessions(packets):
    from packetloom.streaming.jobs import flow_session_stream
    from packetloom.streaming.replay import replay

    return replay(packets, _append(flow_session_stream), close=True)


@query("packets")
def stream_scan_classifier(packets):
    from packetloom.streaming.replay import replay
    from packetloom.streaming.state import scan_state_stream

    return scans.scan_verdict(replay(packets, _append(lambda s: scan_state_stream(s, origin=DAY)), origin=DAY)).drop("ts_s")


@query("packets")
def stream_flow_running(packets):
    from packetloom.streaming.replay import replay
    from packetloom.streaming.state import running_flow_stream

    # per source and protocol, dense enough for the restart to happen
    out = replay(packets, _append(lambda s: running_flow_stream(s, ["src_ip", "proto"], idle=100_000.0)), origin=DAY)
    return out.drop("ts_s")


@query("packets")
def stream_rate_limit(packets):
    from packetloom.streaming.replay import replay
    from packetloom.streaming.state import rate_limit_stream

    return replay(packets, _append(lambda s: rate_limit_stream(s, ["proto", "src_ip"], "pkt_id", 3, 20.0)), origin=DAY).select("pkt_id", "admitted")


@query("packets")
def stream_decisions(packets):
    from packetloom.streaming.replay import replay
    from packetloom.streaming.state import decision_stream

    return replay(packets, _append(lambda s: decision_stream(s, keep=1_000_000.0)), origin=DAY).select("pkt_id", "decision")


@query("eve")
def stream_alert_ingest(eve):
    """Log lines through the text source, parsed, promoted and normalised on the stream."""
    from packetloom.session import run_folder
    from packetloom.streaming.jobs import run_available
    from packetloom.streaming.sources import alert_lines

    spark = eve.sparkSession
    landing, path, checkpoint = (run_folder(spark, n) for n in ("lines", "out", "checkpoint"))
    for part in (0, 1):
        eve.where(F.col("event_no") % 2 == part).select(
            F.concat_ws("\t", F.col("event_no").cast("string"), F.col("ts_s").cast("string"), "line")).write.mode("append").text(landing)
        run_available(fusion.read_alerts(alert_lines(spark, landing)), path, checkpoint)
    return spark.read.parquet(path).drop("ts_s")


@query("packets", "eve")
def stream_alert_fusion(packets, eve):
    """Packets and a late alert log as streams: the best alert of every packet that has one."""
    from packetloom.streaming.jobs import fuse_to_table
    from packetloom.streaming.matching import match_stream
    from packetloom.streaming.replay import replay

    def run(stream, path, checkpoint):
        feed = stream()
        p = feed.where("is_packet").withColumnRenamed("dest_ip", "dst_ip")
        fuse_to_table(match_stream(p, feed.where("not is_packet"), origin=DAY), path, checkpoint)

    feeds = _two_feeds(packets, fusion.read_alerts(eve), delay=5.0)
    return replay(feeds, run, close=True, origin=DAY, by="arrives").select("pkt_id", "tier", "event_no")


@query("packets", "eve")
def stream_dashboard(packets, eve):
    """Packet events with their alerts land as a stream and feed the dashboard tables."""
    from packetloom.streaming.jobs import dashboard_to_table, read_dashboard
    from packetloom.streaming.replay import replay

    events = materialise(fusion.packet_events(packets, fusion.read_alerts(eve)), "events")
    read = lambda path: read_dashboard(packets.sparkSession, path)
    return replay(events, lambda stream, path, checkpoint: dashboard_to_table(stream(), path, checkpoint), read=read)


@query("predictions_multi", "packets")
def stream_predictions_30s(predictions, packets):
    from packetloom.streaming.jobs import prediction_counts_stream
    from packetloom.streaming.replay import replay

    timed = predictions.select("pkt_id", "predicted").join(packets.select("pkt_id", "ts_s"), "pkt_id")
    return replay(timed, _append(lambda s: prediction_counts_stream(s, "predicted")), close=True)


@query("packets", "nslkdd")
def stream_scoring(packets, kdd):
    """A model trained on the batch records scores the packets as they land."""
    from packetloom.plans.training import score, train_model
    from packetloom.streaming.jobs import score_stream
    from packetloom.streaming.replay import replay

    names = ["length", "ttl", "sport", "dport", "tcp_flags", "tcp_window"]
    labelled = materialise(encoding.encode_label(packets.join(kdd.select("pkt_id", "label"), "pkt_id"), "label"), "records")
    model = train_model("decision_tree", labelled, labelled, names, ["pkt_id"], maxDepth=4).model
    scorer = lambda df: score(df, model, names, ["pkt_id", "ts_s"]).select("pkt_id", "ts_s", "predicted", "confidence")
    return replay(packets, _append(lambda s: score_stream(s, scorer))).drop("ts_s")


def _two_feeds(packets, alerts, delay: float):
    """Packets and alerts as one landing table; alerts arrive ``delay`` seconds after their time."""
    p = packets.select(F.lit(True).alias("is_packet"), F.col("ts_s").alias("arrives"), "ts_s", "pkt_id", "src_ip", F.col("dst_ip").alias("dest_ip"),
                       "sport", "dport", "proto", "length")
    a = alerts.select(F.lit(False).alias("is_packet"), (F.col("ts_s") + delay).alias("arrives"), "ts_s", "event_no", "src_ip", "dest_ip", "signature", "severity")
    return materialise(p.unionByName(a, allowMissingColumns=True), "feeds")


@query("packets", "eve")
def stream_packet_events(packets, eve):
    """Packets and a late alert log as streams: every packet as an event with its alert."""
    from packetloom.streaming.matching import events_to_table
    from packetloom.streaming.replay import replay

    def run(stream, path, checkpoint):
        feed = stream()
        p = feed.where("is_packet").withColumnRenamed("dest_ip", "dst_ip")
        events_to_table(p, feed.where("not is_packet"), path, checkpoint, origin=DAY)

    feeds = _two_feeds(packets, fusion.read_alerts(eve), delay=20.0)
    return replay(feeds, run, close=True, origin=DAY, by="arrives").drop("batch")
