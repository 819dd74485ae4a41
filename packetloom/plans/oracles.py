"""The same results as plain SQL for DuckDB, written independently of the operators."""

from __future__ import annotations

from packetloom import vocab
from packetloom.fixtures import with_views

ORACLES: dict[str, str] = {}


def oracle(name: str, views: tuple[str, ...], sql: str, extra: str = "") -> None:
    """Register; ``extra`` holds further CTEs."""
    head = with_views(*views) if views else ""
    if extra:
        head = f"{head},\n{extra}" if head else f"WITH {extra}"
    ORACLES[name] = f"{head}\n{sql}".strip()


def ints(values) -> str:
    return ", ".join(str(v) for v in values)


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def case_map(expr: str, mapping: dict, default: str) -> str:
    arms = " ".join(f"WHEN {k} THEN '{v}'" for k, v in mapping.items())
    return f"CASE {expr} {arms} ELSE {default} END"


def one_hot(expr: str, values, prefix: str) -> str:
    return ", ".join(f"CASE WHEN {expr} = '{v}' THEN 1 ELSE 0 END AS \"{prefix}_{v}\"" for v in values)


def contains_any(expr: str, patterns) -> str:
    return "(" + " OR ".join(f"contains({expr}, '" + p.replace("'", "''") + "')" for p in patterns) + ")"


P = ("packets",)
FIVE = "src_ip, dst_ip, proto, sport, dport"
COMMON = ints(vocab.COMMON_PORTS)
SAFE = ints(vocab.SAFE_PORTS)


def bit(name: str) -> str:
    return f"((tcp_flags & {vocab.TCP_BITS[name]}) <> 0)"


TCP_BIT = {n: f"(proto = 6 AND {bit(n)})" for n in vocab.TCP_BITS}
ANOMALY = (f"CASE WHEN proto = 6 AND {bit('SYN')} AND {bit('ACK')} AND {bit('FIN')} THEN 'TCP_ANOMALY: SYN-ACK-FIN flags set' "
           f"WHEN proto = 6 AND {bit('SYN')} AND {bit('RST')} THEN 'TCP_ANOMALY: SYN-RST flags set' "
           f"WHEN proto = 6 AND tcp_window = 0 AND NOT {bit('ACK')} THEN 'TCP_ANOMALY: Zero window without ACK' END")
EXACT = f"CASE WHEN proto = 6 THEN {case_map('tcp_flags', vocab.EXACT_FLAGS, chr(39) + 'OTH' + chr(39))} ELSE 'OTH' END"
RULES = (f"CASE WHEN {TCP_BIT['SYN']} AND {TCP_BIT['ACK']} THEN 'SF' WHEN {TCP_BIT['SYN']} THEN 'S0' "
         f"WHEN {TCP_BIT['FIN']} AND {TCP_BIT['ACK']} THEN 'SF' WHEN {TCP_BIT['RST']} THEN 'RSTO' WHEN {TCP_BIT['FIN']} THEN 'SF' ELSE 'OTH' END")
PROTO_TEXT = "CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'other' END"
PROTO_NAME = "CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' ELSE 'Proto-' || proto END"
SERVICE_47 = f"CASE WHEN proto IN (6, 17) THEN {case_map('dport', {**vocab.REGISTERED_SERVICES, **vocab.SERVICES_47}, chr(39) + 'other' + chr(39))} ELSE 'other' END"
SERVICE_69 = f"CASE WHEN proto IN (6, 17) THEN {case_map('dport', {**vocab.REGISTERED_SERVICES, **vocab.SERVICES_69}, chr(39) + 'other' + chr(39))} ELSE 'other' END"


def http_class(text: str) -> str:
    low = f"lower({text})"
    return "CASE " + " ".join(f"WHEN {contains_any(low, ps)} THEN 'HTTP_{n}'" for n, ps in vocab.HTTP_PATTERNS.items()) + " END"


def dns_class(text: str) -> str:
    low = f"lower({text})"
    return (f"CASE WHEN length({low}) > 50 THEN 'DNS_TUNNELING' WHEN {contains_any(low, vocab.DNS_KEYWORDS)} THEN 'DNS_EXFILTRATION' "
            f"WHEN length(regexp_replace({low}, '[^0-9]', '', 'g')) > 5 THEN 'DNS_EXFILTRATION' END")


# --- detectors ---------------------------------------------------------------------------
SCAN_STATE = """
scan_gaps AS (SELECT *, CASE WHEN ts_s - LAG(ts_s) OVER w <= 60 THEN 0 ELSE 1 END AS fresh FROM packets WINDOW w AS (PARTITION BY src_ip ORDER BY ts_s, pkt_id)),
scan_sessions AS (SELECT *, SUM(fresh) OVER (PARTITION BY src_ip ORDER BY ts_s, pkt_id ROWS UNBOUNDED PRECEDING) AS sid FROM scan_gaps),
scan_firsts AS (SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY src_ip, sid, dport ORDER BY ts_s, pkt_id) = 1 THEN 1 ELSE 0 END AS fp,
  CASE WHEN ROW_NUMBER() OVER (PARTITION BY src_ip, sid, dst_ip ORDER BY ts_s, pkt_id) = 1 THEN 1 ELSE 0 END AS ft FROM scan_sessions),
scan_counts AS (SELECT *, CAST(SUM(fp) OVER w AS BIGINT) AS n_ports, CAST(SUM(ft) OVER w AS BIGINT) AS n_targets FROM scan_firsts
  WINDOW w AS (PARTITION BY src_ip, sid ORDER BY ts_s, pkt_id ROWS UNBOUNDED PRECEDING)),
scan_kinds AS (SELECT *, CASE WHEN n_ports >= 5 AND n_targets = 1 THEN 'HORIZONTAL_SCAN' WHEN n_targets >= 5 AND n_ports = 1 THEN 'VERTICAL_SCAN'
  WHEN n_targets >= 5 AND n_ports >= 5 THEN 'DISTRIBUTED_SCAN' END AS scan FROM scan_counts),
scan_alerts AS (SELECT pkt_id, src_ip, dst_ip, dport, n_ports, n_targets, scan,
  CASE scan WHEN 'HORIZONTAL_SCAN' THEN 'HORIZONTAL_SCAN from ' || src_ip || ' to ' || dst_ip || ' (' || n_ports || ' ports)'
    WHEN 'VERTICAL_SCAN' THEN 'VERTICAL_SCAN from ' || src_ip || ' (port ' || dport || ' to ' || n_targets || ' hosts)'
    ELSE 'DISTRIBUTED_SCAN from ' || src_ip || ' (' || n_ports || ' ports to ' || n_targets || ' hosts)' END AS alert FROM scan_kinds WHERE scan IS NOT NULL)""".strip()
oracle("scan_classifier", P, "SELECT * FROM scan_alerts", SCAN_STATE)


def window_scan(pair: str, value: str, source: str = "packets") -> str:
    return f"""SELECT pkt_id, {pair}, {value}, n_distinct FROM (
  SELECT pkt_id, {pair}, {value}, COUNT(DISTINCT {value}) OVER (PARTITION BY {pair} ORDER BY ts_s RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n_distinct,
    ts_s - LAG(ts_s) OVER (PARTITION BY {pair}, {value} ORDER BY ts_s, pkt_id) AS pause
  FROM {source} WHERE proto IN (6, 17) AND dport > 0) WHERE n_distinct >= 5 AND (pause IS NULL OR pause > 60)"""


oracle("horizontal_scan_60s", P, f"SELECT *, 'HORIZONTAL_PORT_SCAN from ' || src_ip || ' to ' || dst_ip || ' (' || n_distinct || ' ports)' AS alert FROM ({window_scan('src_ip, dst_ip', 'dport')})")
oracle("vertical_scan_60s", P, f"SELECT *, 'VERTICAL_PORT_SCAN from ' || src_ip || ' (port ' || dport || ' to ' || n_distinct || ' hosts)' AS alert FROM ({window_scan('src_ip, dport', 'dst_ip')})")
FLOOD = "COUNT(*) OVER (ORDER BY ts_s RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) / CAST(10 AS DOUBLE)"
oracle("flood_rate_10s", P, f"SELECT pkt_id, pps, pps > 3.0 AS is_flood FROM (SELECT pkt_id, {FLOOD} AS pps FROM packets)")
oracle("flood_rate_per_target", P, f"SELECT pkt_id, dst_ip, pps, pps > 0.5 AS is_flood FROM (SELECT pkt_id, dst_ip, {FLOOD.replace('(ORDER', '(PARTITION BY dst_ip ORDER')} AS pps FROM packets)")
FLOOD_ALERTS = f"flood_hits AS (SELECT pkt_id, 'POTENTIAL_DOS_DETECTED: ' || printf('%.1f', pps) || ' packets/second' AS alert FROM (SELECT pkt_id, {FLOOD} AS pps FROM packets) WHERE pps > 3.0)"
oracle("flood_alerts", P, "SELECT * FROM flood_hits", FLOOD_ALERTS)
DROPPED = f"(sport IN ({COMMON}) OR dport IN ({COMMON}))"
LOAD = "CASE WHEN total / CAST(2 AS DOUBLE) > 5000 THEN 'very_high' WHEN total / CAST(2 AS DOUBLE) > 1000 THEN 'high' ELSE 'normal' END"
oracle("throughput_2s", P, f"""SELECT *, total / CAST(2 AS DOUBLE) AS pps, dropped / CAST(total AS DOUBLE) * 100 AS drop_pct, attacks / CAST(2 AS DOUBLE) AS attacks_per_s, {LOAD} AS load FROM (
SELECT CAST(FLOOR(ts_s / 2) * 2 AS BIGINT) AS window_start, COUNT(*) AS total, COUNT(*) FILTER (WHERE NOT {DROPPED}) AS processed,
  COUNT(*) FILTER (WHERE {DROPPED}) AS dropped, COUNT(*) FILTER (WHERE {ANOMALY} IS NOT NULL) AS attacks FROM packets GROUP BY 1)""")
oracle("predictions_30s", ("predictions_multi",), """SELECT CAST(FLOOR(ts_s / 30) * 30 AS BIGINT) AS window_start, predicted, COUNT(*) AS n
FROM predictions_multi JOIN packets USING (pkt_id) GROUP BY 1, 2""")
oracle("tcp_anomalies", P, f"SELECT * FROM (SELECT pkt_id, {ANOMALY} AS anomaly FROM packets) WHERE anomaly IS NOT NULL")
oracle("conn_flag_exact", P, f"SELECT pkt_id, {EXACT} AS flag FROM packets")
oracle("conn_flag_rules", P, f"SELECT pkt_id, {RULES} AS flag, CASE WHEN {TCP_BIT['SYN']} AND {TCP_BIT['ACK']} THEN 1 ELSE 0 END AS logged_in FROM packets")
oracle("flag_bits", P, "SELECT pkt_id, " + ", ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END AS \"tcp_flag_{n}\"" for n, c in TCP_BIT.items()) + " FROM packets")
TEXT_ENTROPY = """char_counts AS (SELECT pkt_id, c, COUNT(*) AS n FROM (SELECT pkt_id, UNNEST(string_split(payload, '')) AS c FROM packets) GROUP BY 1, 2),
text_entropy AS (SELECT pkt_id, -SUM(n / CAST(t AS DOUBLE) * log2(n / CAST(t AS DOUBLE))) AS entropy FROM (SELECT *, SUM(n) OVER (PARTITION BY pkt_id) AS t FROM char_counts) GROUP BY 1)"""
DETECTED = f"""detected AS (SELECT pkt_id, alert AS detection FROM scan_alerts UNION SELECT pkt_id, alert FROM flood_hits
  UNION SELECT pkt_id, {ANOMALY} FROM packets WHERE {ANOMALY} IS NOT NULL
  UNION SELECT pkt_id, 'SHELLCODE_DETECTED' FROM packets JOIN text_entropy USING (pkt_id) WHERE entropy > 6.5)"""
DETECT_CTES = f"{SCAN_STATE},\n{FLOOD_ALERTS},\n{TEXT_ENTROPY},\n{DETECTED}"
oracle("detections", P, "SELECT * FROM detected", DETECT_CTES)
oracle("detections_with_model", ("predictions_multi",), "SELECT * FROM detected UNION SELECT pkt_id, 'ML_DETECTION_' || predicted FROM predictions_multi WHERE confidence > 0.8", DETECT_CTES)
oracle("detection_log", P, "SELECT pkt_id, 'Detected attacks from ' || src_ip || ' to ' || dst_ip || ': ' || detection AS line FROM detected JOIN packets USING (pkt_id)", DETECT_CTES)
oracle("dedupe_detections", P, f"""SELECT pkt_id, COALESCE(string_agg(d, '|' ORDER BY d), '') AS detections, CAST(COUNT(d) AS INTEGER) AS n FROM packets LEFT JOIN (
SELECT DISTINCT pkt_id, d FROM (SELECT pkt_id, {http_class('payload')} AS d FROM packets UNION ALL SELECT pkt_id, {dns_class('dns_query')} FROM packets
UNION ALL SELECT pkt_id, {ANOMALY} FROM packets) WHERE d IS NOT NULL) USING (pkt_id) GROUP BY pkt_id""")
oracle("decision_chain", P, f"""SELECT pkt_id, CASE WHEN ROW_NUMBER() OVER (PARTITION BY {FIVE} ORDER BY ts_s, pkt_id) > 1 THEN 'cached_benign' ELSE 'common_port' END AS decision
FROM packets WHERE {DROPPED} UNION ALL
SELECT pkt_id, CASE WHEN pkt_id IN (SELECT pkt_id FROM h UNION SELECT pkt_id FROM v) THEN 'scan_alert' ELSE 'score' END FROM rest""",
       f"rest AS (SELECT * FROM packets WHERE NOT {DROPPED}), h AS ({window_scan('src_ip, dst_ip', 'dport', 'rest')}), v AS ({window_scan('src_ip, dport', 'dst_ip', 'rest')})")
oracle("decision_cache", P, f"SELECT pkt_id, {FIVE} FROM packets WHERE NOT {DROPPED}")

# --- payload -----------------------------------------------------------------------------
oracle("http_payload_class", P, f"SELECT * FROM (SELECT pkt_id, {http_class('payload')} AS http_class FROM packets) WHERE http_class IS NOT NULL")
oracle("http_payload_documents", (), f"SELECT doc_id, {http_class('text')} AS http_class FROM documents")
oracle("http_payload_pages", (), f"SELECT page_id, {http_class('html')} AS http_class FROM pages")
oracle("dns_class", P, f"SELECT * FROM (SELECT pkt_id, {dns_class('dns_query')} AS dns_class FROM packets) WHERE dns_class IS NOT NULL")
oracle("dns_class_hosts", (), f"SELECT page_id, host, {dns_class('host')} AS dns_class FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages)")
oracle("payload_entropy", P, "SELECT pkt_id, ROUND(entropy, 9) AS entropy FROM text_entropy", TEXT_ENTROPY)


def byte_entropy(source: str, row: str, data: str) -> str:
    """Entropy over the bytes of a hex text."""
    return f"""byte_counts AS (SELECT {row}, b, COUNT(*) AS n FROM (SELECT {row}, UNNEST(regexp_extract_all({data}, '..')) AS b FROM {source}) GROUP BY 1, 2),
byte_entropy AS (SELECT {row}, -SUM(n / CAST(t AS DOUBLE) * log2(n / CAST(t AS DOUBLE))) AS entropy FROM (SELECT *, SUM(n) OVER (PARTITION BY {row}) AS t FROM byte_counts) GROUP BY 1)"""


oracle("payload_entropy_documents", (), "SELECT doc_id, COALESCE(ROUND(entropy, 9), 0) AS entropy FROM documents LEFT JOIN byte_entropy USING (doc_id)", byte_entropy("documents", "doc_id", "hex(encode(text))"))
PRINTABLE = r"CASE WHEN length({c}) > 0 THEN ROUND(length(regexp_replace({c}, '[^\x20-\x7e\t\n\r\x0b\x0c]', '', 'g')) / CAST(length({c}) AS DOUBLE), 9) ELSE CAST(0 AS DOUBLE) END"
oracle("printable_ratio", P, f"SELECT pkt_id, {PRINTABLE.format(c='payload')} AS ratio FROM packets")
oracle("printable_ratio_documents", (), f"SELECT doc_id, {PRINTABLE.format(c='text')} AS ratio FROM documents")
oracle("shellcode_test", (), """SELECT doc_id, COALESCE(entropy, 0) > 6.5 OR regexp_matches(data, '^(..)*?(9090909090909090|0F1F4000)') AS shellcode FROM raw LEFT JOIN byte_entropy USING (doc_id)""",
       "raw AS (SELECT doc_id, hex(encode(text)) || CASE WHEN doc_id % 5 = 0 THEN '9090909090909090' WHEN doc_id % 7 = 0 THEN 'A90909090909090905' ELSE '' END AS data FROM documents),\n"
       + byte_entropy("raw", "doc_id", "data"))

# --- flows -------------------------------------------------------------------------------
BIDIRECTIONAL = """keyed AS (SELECT *, LEAST(src_ip, dst_ip) AS ip_a, GREATEST(src_ip, dst_ip) AS ip_b, CASE WHEN src_ip < dst_ip THEN sport ELSE dport END AS port_a,
  CASE WHEN src_ip < dst_ip THEN dport ELSE sport END AS port_b, NOT (src_ip < dst_ip) AS is_reverse FROM packets),
spaced AS (SELECT *, ts_s - LAG(ts_s) OVER (PARTITION BY ip_a, ip_b, proto, port_a, port_b ORDER BY ts_s, pkt_id) AS pause FROM keyed),
periods AS (SELECT *, SUM(CASE WHEN pause <= 300 THEN 0 ELSE 1 END) OVER (PARTITION BY ip_a, ip_b, proto, port_a, port_b ORDER BY ts_s, pkt_id ROWS UNBOUNDED PRECEDING) AS period,
  CASE WHEN pause <= 300 THEN pause ELSE 0 END AS iat,
  CASE WHEN proto = 6 AND dport < 1024 THEN """ + case_map("dport", vocab.FLOW_SERVICES, "'port_' || dport") + """ END AS service FROM spaced)"""


def distinct_list(expr: str) -> str:
    return f"COALESCE(array_to_string(list_sort(list_distinct(list({expr}))), ','), '')"


oracle("bidirectional_flows", P, f"""SELECT ip_a, ip_b, proto, port_a, port_b, MIN(ts_s) AS first_seen, MAX(ts_s) AS last_seen, COUNT(*) AS packets, CAST(SUM(length) AS BIGINT) AS bytes,
  MIN(length) AS min_length, MAX(length) AS max_length, CAST(SUM(length * length) AS BIGINT) AS length_squares, SUM(iat) AS iat_total, MAX(iat) AS iat_max,
  arg_min(is_reverse, pkt_id) AS is_reverse, {distinct_list('CASE WHEN proto = 6 THEN sport END')} AS src_ports, {distinct_list('CASE WHEN proto = 6 THEN dport END')} AS dst_ports,
  {distinct_list('CASE WHEN proto = 6 THEN tcp_flags END')} AS flag_values, {distinct_list('service')} AS services
FROM periods GROUP BY ip_a, ip_b, proto, port_a, port_b, period""", BIDIRECTIONAL)
oracle("flow_totals", P, """SELECT COUNT(*) AS total_flows, CAST(SUM(n) AS BIGINT) AS total_packets, CAST(SUM(b) AS BIGINT) AS total_bytes, AVG(l - f) AS avg_flow_duration FROM (
SELECT COUNT(*) AS n, SUM(length) AS b, MIN(ts_s) AS f, MAX(ts_s) AS l FROM periods GROUP BY ip_a, ip_b, proto, port_a, port_b, period)""", BIDIRECTIONAL)
oracle("connections", P, f"""SELECT {FIVE}, COUNT(*) AS packet_count, CAST(SUM(length) AS BIGINT) AS bytes_sent, MIN(ts_s) AS start_time, MAX(ts_s) AS last_seen,
concat_ws(',', {', '.join(f"CASE WHEN bool_or({TCP_BIT[n]}) THEN '{n}' END" for n in sorted(vocab.TCP_BITS))}) AS flags FROM packets GROUP BY {FIVE}""")
oracle("flow_flag_counts", P, f"""SELECT {FIVE}, {', '.join(f"COUNT(*) FILTER (WHERE {TCP_BIT[n]}) AS {n.lower()}_count" for n in ('SYN', 'ACK', 'FIN', 'RST'))},
COUNT(*) AS packet_count, CAST(SUM(length) AS BIGINT) AS byte_count, ROUND(AVG(length), 6) AS avg_packet_size FROM packets GROUP BY {FIVE}""")
RUNNING = f"""run AS (SELECT *, COUNT(*) OVER w AS flow_packets, CAST(SUM(length) OVER w AS BIGINT) AS flow_bytes, ts_s - FIRST_VALUE(ts_s) OVER w AS flow_duration,
  ts_s - LAG(ts_s) OVER (PARTITION BY {FIVE} ORDER BY ts_s, pkt_id) AS iat FROM packets WINDOW w AS (PARTITION BY {FIVE} ORDER BY ts_s, pkt_id ROWS UNBOUNDED PRECEDING))"""
RATE = "CASE WHEN flow_duration > 0 THEN flow_packets / flow_duration ELSE CAST(0 AS DOUBLE) END"
oracle("flow_running", P, f"SELECT pkt_id, flow_packets, flow_bytes, flow_duration, ROUND({RATE}, 9) AS packet_rate, ROUND(flow_packets / GREATEST(flow_duration, CAST(0.001 AS DOUBLE)), 6) AS packets_per_second FROM run", RUNNING)
oracle("flow_iat", P, "SELECT pkt_id, iat, COALESCE(iat, 0) AS iat_or_zero FROM run", RUNNING)
oracle("flow_sessions", P, f"""SELECT {FIVE}, CAST(sid AS INTEGER) AS session_no, MIN(ts_s) AS first_seen, MAX(ts_s) AS last_seen, COUNT(*) AS packets, CAST(SUM(length) AS BIGINT) AS bytes FROM (
SELECT *, SUM(CASE WHEN iat <= 300 THEN 0 ELSE 1 END) OVER (PARTITION BY {FIVE} ORDER BY ts_s, pkt_id ROWS UNBOUNDED PRECEDING) AS sid FROM run) GROUP BY {FIVE}, sid""", RUNNING)
RESET = """WITH RECURSIVE {views}, numbered AS (SELECT pkt_id, {key_list}, ts_s, ROW_NUMBER() OVER (PARTITION BY {key_list} ORDER BY ts_s, pkt_id) AS rn FROM packets),
walk AS (SELECT pkt_id, {key_list}, ts_s, rn, ts_s AS origin, CAST(1 AS BIGINT) AS flow_packet_count FROM numbered WHERE rn = 1
  UNION ALL SELECT n.pkt_id, {n_keys}, n.ts_s, n.rn, CASE WHEN w.ts_s - w.origin > 60 THEN n.ts_s ELSE w.origin END,
  CASE WHEN w.ts_s - w.origin > 60 THEN 1 ELSE w.flow_packet_count + 1 END FROM walk w JOIN numbered n ON {match} AND n.rn = w.rn + 1)"""


def reset_ctes(keys: list[str]) -> str:
    return RESET.format(views=with_views("packets")[5:], key_list=", ".join(keys), n_keys=", ".join(f"n.{k}" for k in keys), match=" AND ".join(f"n.{k} = w.{k}" for k in keys))


ORACLES["flow_reset_60s"] = reset_ctes(["src_ip"]) + """ SELECT pkt_id, src_ip, flow_packet_count, ts_s - origin AS flow_duration,
ROUND(CASE WHEN ts_s > origin THEN flow_packet_count / (ts_s - origin) ELSE CAST(0 AS DOUBLE) END, 9) AS packet_rate FROM walk"""
ORACLES["rate_limit"] = f"""WITH RECURSIVE {with_views('packets')[5:]}, numbered AS (SELECT pkt_id, proto, src_ip, ts_s, ROW_NUMBER() OVER (PARTITION BY proto, src_ip ORDER BY ts_s, pkt_id) AS rn FROM packets),
walk AS (SELECT pkt_id, proto, src_ip, rn, true AS admitted, [ts_s] AS recent FROM numbered WHERE rn = 1
  UNION ALL SELECT n.pkt_id, n.proto, n.src_ip, n.rn, len(list_filter(w.recent, lambda t: n.ts_s - t < 20)) < 3,
    CASE WHEN len(list_filter(w.recent, lambda t: n.ts_s - t < 20)) < 3 THEN list_append(list_filter(w.recent, lambda t: n.ts_s - t < 20), n.ts_s)
      ELSE list_filter(w.recent, lambda t: n.ts_s - t < 20) END
  FROM walk w JOIN numbered n ON n.proto = w.proto AND n.src_ip = w.src_ip AND n.rn = w.rn + 1)
SELECT pkt_id, admitted FROM walk"""
KDD_COUNTS = ", ".join(f"flow_packets AS \"{n}\"" for n in vocab.COUNT_FIELDS_69)
KDD_RATES = ", ".join([f"CAST(0 AS DOUBLE) AS {n}" for n in vocab.ZERO_RATES_69] + [f"CAST(1 AS DOUBLE) AS {n}" for n in vocab.ONE_RATES_69])
oracle("kdd_counts_faithful", P, f"SELECT pkt_id, {KDD_COUNTS}, {KDD_RATES} FROM run", RUNNING)
oracle("kdd_counts_2s", P, """SELECT pkt_id, n AS "count", sn AS srv_count, ROUND(s0 / CAST(n AS DOUBLE), 9) AS serror_rate, ROUND(rej / CAST(n AS DOUBLE), 9) AS rerror_rate,
ROUND(ss0 / CAST(sn AS DOUBLE), 9) AS srv_serror_rate, ROUND(srej / CAST(sn AS DOUBLE), 9) AS srv_rerror_rate, ROUND(sn / CAST(n AS DOUBLE), 9) AS same_srv_rate FROM (
SELECT pkt_id, COUNT(*) OVER h AS n, COUNT(*) FILTER (WHERE st = 'S0') OVER h AS s0, COUNT(*) FILTER (WHERE st = 'REJ') OVER h AS rej,
  COUNT(*) OVER s AS sn, COUNT(*) FILTER (WHERE st = 'S0') OVER s AS ss0, COUNT(*) FILTER (WHERE st = 'REJ') OVER s AS srej FROM stated
  WINDOW h AS (PARTITION BY dst_ip ORDER BY ts_s RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), s AS (PARTITION BY dst_ip, svc ORDER BY ts_s RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))""",
       f"stated AS (SELECT pkt_id, ts_s, dst_ip, {EXACT} AS st, {SERVICE_69} AS svc FROM packets)")

# --- feature records ---------------------------------------------------------------------
BYTES = "COALESCE(octet_length(encode(payload)), 0)"
LAND_PORTS = "CASE WHEN src_ip = dst_ip AND sport = dport THEN 1 ELSE 0 END"
BITS = ", ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END AS \"tcp_flag_{n}\"" for n, c in TCP_BIT.items())


def if_proto(n: int, expr: str, name: str) -> str:
    return f"CASE WHEN proto = {n} THEN {expr} ELSE 0 END AS {name}"


def record_47(count: str, duration: str, rate: str) -> str:
    return f"""pkt_id, ROUND(ts_s, 6) AS duration, CAST({BYTES} AS INTEGER) AS src_bytes, 0 AS dst_bytes, {LAND_PORTS} AS land, {one_hot(PROTO_TEXT, vocab.PROTOCOLS_47, 'protocol_type')},
{one_hot(SERVICE_47, vocab.SERVICE_COLUMNS_47, 'service')}, {one_hot(EXACT, vocab.FLAG_COLUMNS_47, 'flag')}, {if_proto(6, 'sport', 'tcp_sport')}, {if_proto(6, 'dport', 'tcp_dport')},
{if_proto(6, 'tcp_window', 'tcp_window')}, {BITS}, {if_proto(17, 'sport', 'udp_sport')}, {if_proto(17, 'dport', 'udp_dport')}, {if_proto(17, 'length - 20', 'udp_len')},
0 AS icmp_type, 0 AS icmp_code, {count} AS flow_packet_count, ROUND({duration}, 6) AS flow_duration, ROUND({rate}, 6) AS packet_rate"""


oracle("features_47", P, f"SELECT {record_47('flow_packets', 'flow_duration', RATE)} FROM run", RUNNING)
ORACLES["features_47_reset"] = reset_ctes(FIVE.split(", ")) + ", " + TEXT_ENTROPY.replace("string_split(payload, '')", "regexp_extract_all(hex(encode(payload)), '..')") + f""",
timed AS (SELECT p.*, w.flow_packet_count AS fpc, w.ts_s - w.origin AS fd, COALESCE(ROUND(e.entropy, 6), 0) AS payload_entropy FROM packets p JOIN walk w USING (pkt_id) LEFT JOIN text_entropy e USING (pkt_id))
SELECT {record_47('fpc', 'fd', 'CASE WHEN fd > 0 THEN fpc / fd ELSE CAST(0 AS DOUBLE) END')}, payload_entropy FROM timed"""
oracle("features_69", P, f"""SELECT pkt_id, src_ip, dst_ip, CASE WHEN src_ip = dst_ip THEN 1 ELSE 0 END AS land, {', '.join(f'0 AS {n}' for n in vocab.ZERO_FIELDS_69)}, sport, dport, length AS packet_size, ttl,
CAST({BYTES} AS INTEGER) AS src_bytes, 0 AS dst_bytes, ROUND(flow_duration, 6) AS duration, {KDD_COUNTS}, {KDD_RATES}, {one_hot(PROTO_TEXT, vocab.PROTOCOLS_69, 'protocol_type')},
{one_hot(SERVICE_69, vocab.SERVICE_COLUMNS_69, 'service')}, {one_hot(EXACT, vocab.FLAG_COLUMNS_69, 'flag')} FROM run""", RUNNING)
PRIVILEGED = "(dport > 0 AND dport < 1024)"
LOGIN = f"{PRIVILEGED} AND dport IN ({ints(vocab.LOGIN_PORTS)})"
COMMON_SERVICE = f"{PRIVILEGED} AND dport NOT IN ({ints(vocab.LOGIN_PORTS)}) AND dport IN ({ints(vocab.COMMON_SERVICE_PORTS)})"
D = "GREATEST(CAST(0.001 AS DOUBLE), flow_duration)"
flag = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
oracle("cic_live_features", P, f"""SELECT pkt_id, ROUND({D}, 6) AS duration, CASE proto WHEN 17 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS protocol_type, dport AS service, {RULES} AS flag,
CAST({BYTES} AS INTEGER) AS src_bytes, 0 AS dst_bytes, {LAND_PORTS} AS land, 0 AS wrong_fragment, 0 AS urgent, {flag(BYTES + ' > 10000')} AS hot, {flag(LOGIN)} AS num_failed_logins,
{flag(TCP_BIT['SYN'] + ' AND ' + TCP_BIT['ACK'])} AS logged_in, 0 AS num_compromised, 0 AS root_shell, 0 AS su_attempted, 0 AS num_root, {flag(f'{BYTES} > 0 AND 0 > {BYTES} * 10')} AS num_file_creations,
0 AS num_shells, 0 AS num_access_files, 0 AS num_outbound_cmds, {flag('ttl <= 64')} AS is_host_login, {flag('ttl > 64 AND ttl <= 128')} AS is_guest_login,
1 AS "count", 1 AS srv_count, 1 AS dst_host_count, 1 AS dst_host_srv_count, ROUND({D}, 6) AS flow_duration, ROUND(flow_packets / {D}, 6) AS "fwd_packets/s", CAST(0 AS DOUBLE) AS "bwd_packets/s",
length AS packet_length, length AS min_packet_length, length AS max_packet_length, CASE WHEN flow_packets > 1 THEN ROUND({D}, 6) ELSE CAST(0 AS DOUBLE) END AS fwd_iat_total,
CASE WHEN flow_packets > 1 THEN ROUND({D} / (flow_packets - 1), 6) ELSE CAST(0 AS DOUBLE) END AS fwd_iat_mean, CASE WHEN flow_packets > 1 THEN ROUND({D} / (flow_packets - 1) * CAST(0.5 AS DOUBLE), 6) ELSE CAST(0 AS DOUBLE) END AS fwd_iat_std,
{if_proto(6, 'tcp_window', 'init_win_bytes_forward')}, CASE WHEN proto = 6 AND tcp_window > 0 THEN LEAST(tcp_window, 1460) ELSE 536 END AS min_seg_size_forward,
CASE WHEN {BYTES} > 0 THEN ROUND({BYTES} / {D}, 6) ELSE CAST(0 AS DOUBLE) END AS "flow_bytes/s", ROUND(flow_packets / {D}, 6) AS "flow_packets/s", {flag(PRIVILEGED)} AS is_privileged_port, {flag(COMMON_SERVICE)} AS is_common_port,
{', '.join(f"{flag(TCP_BIT[n.upper()])} AS tcp_flag_{n}" for n in ('syn', 'ack', 'fin', 'rst', 'psh', 'urg'))}, {one_hot(RULES, vocab.FLAG_COLUMNS_69, 'flag')},
sport, dport, ttl, src_ip, dst_ip, ROUND(ts_s, 6) AS "timestamp" FROM run""", RUNNING)
oracle("header_features", P, f"""SELECT pkt_id, src_ip, dst_ip, length AS ip_len, ttl AS ip_ttl, proto AS ip_proto, sport, dport, CASE WHEN proto = 6 THEN tcp_flags END AS tcp_flags, CASE WHEN proto = 6 THEN tcp_window END AS tcp_window,
CASE WHEN proto = 17 THEN length - 20 END AS udp_len, ROUND(flow_duration, 6) AS flow_duration, ROUND(flow_packets / {D}, 6) AS packets_per_second, CAST(length(payload) AS INTEGER) AS payload_length,
ROUND(entropy, 6) AS entropy, ROUND({PRINTABLE.format(c='payload')}, 6) AS printable_ratio FROM run JOIN text_entropy USING (pkt_id)""", f"{RUNNING},\n{TEXT_ENTROPY}")
oracle("labelled_capture", ("mixed_packets",), f"""SELECT pkt_id, concat_ws('-', src_ip, dst_ip, {PROTO_TEXT}, sport, dport) AS flow_id, 'attack' AS label, COUNT(*) OVER w AS "count",
ROUND(ts_s - FIRST_VALUE(ts_s) OVER w, 6) AS duration, {flag(SERVICE_69 + " = 'http'")} AS service_http, {flag(EXACT + " = 'S0'")} AS "flag_S0"
FROM (SELECT * FROM mixed_packets WHERE ip_version IN (4, 6) ORDER BY ts_s, pkt_id LIMIT 1000) WINDOW w AS (PARTITION BY {FIVE} ORDER BY ts_s, pkt_id ROWS UNBOUNDED PRECEDING)""")
oracle("align_features", ("cic_flows",), "SELECT tot_byts, CAST(0 AS DOUBLE) AS fwd_seg_size_min, COALESCE(idle_mean, 0) AS idle_mean, flow_duration FROM cic_flows")
oracle("protocol_service", P, f"SELECT pkt_id, {PROTO_TEXT} AS protocol, {PROTO_NAME} AS protocol_name, CASE proto WHEN 17 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS protocol_code, {SERVICE_47} AS service FROM packets")
oracle("land_test", P, f"SELECT pkt_id, {flag('src_ip = dst_ip')} AS land_hosts, {LAND_PORTS} AS land_ports FROM packets")
oracle("flow_rates", P, """SELECT src_ip, dst_ip, proto, sport, dport, ROUND(d, 6) AS duration, ROUND(d, 6) AS flow_duration, ROUND(n / d, 6) AS fwd_packets_per_s, ROUND(n / d, 6) AS flow_packets_per_s,
CASE WHEN n > 1 THEN ROUND(d / (n - 1), 6) ELSE CAST(0 AS DOUBLE) END AS fwd_iat_mean, CASE WHEN n > 1 THEN ROUND(d, 6) ELSE CAST(0 AS DOUBLE) END AS fwd_iat_total, CASE WHEN n > 1 THEN ROUND(d / (n - 1) * CAST(0.5 AS DOUBLE), 6) ELSE CAST(0 AS DOUBLE) END AS fwd_iat_std,
CASE WHEN s + r > 0 THEN ROUND((s + r) / d, 6) ELSE CAST(0 AS DOUBLE) END AS flow_bytes_per_s, CASE WHEN s + r > 10000 THEN 1 ELSE 0 END AS hot, CASE WHEN s + r > 0 AND r > s * 10 THEN 1 ELSE 0 END AS num_file_creations FROM g""",
       f"g AS (SELECT {FIVE}, SUM({BYTES}) AS s, SUM(CASE WHEN pkt_id % 7 = 0 THEN length * 40 ELSE 0 END) AS r, GREATEST(CAST(0.001 AS DOUBLE), MAX(ts_s) - MIN(ts_s)) AS d, COUNT(*) AS n FROM packets GROUP BY {FIVE})")
oracle("port_window_flags", P, f"SELECT pkt_id, CASE WHEN tcp_window > 0 THEN LEAST(tcp_window, 1460) ELSE 536 END AS min_seg, {flag(PRIVILEGED)} AS privileged, {flag(LOGIN)} AS login, {flag(COMMON_SERVICE)} AS common FROM packets")
oracle("ttl_fingerprint", P, f"SELECT pkt_id, {flag('ttl <= 64')} AS host, {flag('ttl > 64 AND ttl <= 128')} AS guest FROM packets")
oracle("flow_id_text", P, f"SELECT pkt_id, concat_ws('-', {FIVE}) AS flow_id FROM packets")
oracle("time_text", (), """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS second_text, strftime(ts, '%H:%M:%S.%g') AS clock_text, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso_text, epoch_us(ts) AS epoch_us FROM events""")
oracle("json_props", (), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text, json_extract_string(props, '$.none') AS absent FROM events")
oracle("string_basics", ("cic_flows",), """SELECT label, COUNT(*) AS n, trim(label) AS stripped, upper(trim(label)) AS upper_text, lower(label) AS lower_text, replace(label, ' ', '_') AS underscored,
starts_with(label, 'DoS') AS is_dos, string_split(trim(label), ' ')[1] AS first_word, contains(lower(label), 'scan') AS has_scan, COALESCE(regexp_full_match(label, '\\d+'), false) AS is_digit FROM cic_flows GROUP BY label""")
oracle("math_basics", P, """SELECT pkt_id, ROUND(log2(length), 9) AS log_length, GREATEST(100, LEAST(1000, length)) AS clamped, round_even(length / CAST(7 AS DOUBLE), 2) AS seventh, tcp_flags & 18 AS syn_ack_bits,
CAST(len(list_distinct([sport, dport, tcp_window])) AS INTEGER) AS distinct_numbers, (dport - sport) + (ttl - length) AS zip_difference FROM packets""")

# --- alerts and fusion -------------------------------------------------------------------
EVENTS = """events_ok AS (SELECT event_no, ts_s, CAST(line AS JSON) AS j FROM eve WHERE json_valid(line)),
raw_alerts AS (SELECT event_no, ts_s, json_extract_string(j, '$.event_type') AS event_type, json_extract_string(j, '$.src_ip') AS src_ip, json_extract_string(j, '$.dest_ip') AS dest_ip,
  json_extract_string(j, '$.alert.signature') AS signature, CAST(json_extract_string(j, '$.alert.severity') AS INTEGER) AS severity, CAST(json_extract_string(j, '$.alert.signature_id') AS INTEGER) AS signature_id,
  COALESCE(CAST(json_extract_string(j, '$.flow.alerted') AS BOOLEAN), false) AS alerted FROM events_ok),
every_alert AS (SELECT event_no, ts_s, src_ip, dest_ip, COALESCE(signature, 'Flow Event ' || src_ip || '->' || dest_ip) AS signature,
  CASE WHEN signature IS NOT NULL THEN CASE WHEN severity = 0 THEN 3 ELSE severity END WHEN alerted THEN 3 ELSE 5 END AS severity, COALESCE(signature_id, 999999) AS signature_id, signature IS NOT NULL OR alerted AS real_alert FROM raw_alerts),
alerts AS (SELECT * FROM every_alert WHERE real_alert)"""
oracle("alert_rows", ("eve",), "SELECT event_no, src_ip, dest_ip, signature, CAST(severity AS BIGINT) AS severity, CAST(signature_id AS BIGINT) AS signature_id FROM raw_alerts WHERE event_type = 'alert'", EVENTS)
oracle("flow_promote", ("eve",), "SELECT event_no, signature, CAST(severity AS BIGINT) AS severity, CAST(signature_id AS BIGINT) AS signature_id FROM every_alert WHERE signature_id = 999999", EVENTS)
oracle("alert_normalise", ("eve",), "SELECT event_no, src_ip, dest_ip, signature, severity, signature_id FROM alerts", EVENTS)
FUSED = f"""{EVENTS},
touching AS (SELECT p.pkt_id, a.event_no, a.ts_s AS ats, CASE WHEN a.src_ip = p.src_ip AND a.dest_ip = p.dst_ip THEN 1 WHEN a.src_ip = p.dst_ip AND a.dest_ip = p.src_ip THEN 2 ELSE 3 END AS tier
  FROM packets p JOIN alerts a ON a.ts_s BETWEEN p.ts_s - 30 AND p.ts_s AND (a.src_ip IN (p.src_ip, p.dst_ip) OR a.dest_ip IN (p.src_ip, p.dst_ip))),
best AS (SELECT pkt_id, tier, event_no FROM touching QUALIFY ROW_NUMBER() OVER (PARTITION BY pkt_id ORDER BY tier, ats DESC, event_no DESC) = 1)"""
oracle("alert_fusion", ("eve",), "SELECT pkt_id, tier, event_no FROM packets LEFT JOIN best USING (pkt_id)", FUSED)
PACKET_EVENTS = f"""{FUSED},
packet_events AS (SELECT p.pkt_id, p.ts_s, p.src_ip, sport AS src_port, p.dst_ip, dport AS dst_port, {PROTO_NAME} AS protocol, length, b.tier IS NOT NULL AS is_alert, a.signature, a.severity,
  CASE WHEN b.tier IS NOT NULL THEN 'suricata_alert' END AS category, dport IN ({ints(vocab.WHITELISTED_PORTS)}) OR p.src_ip = '127.0.0.1' OR p.dst_ip = '127.0.0.1' AS whitelisted
  FROM packets p LEFT JOIN best b USING (pkt_id) LEFT JOIN alerts a USING (event_no))"""
oracle("packet_events", ("eve",), "SELECT * FROM packet_events", PACKET_EVENTS)


def last_octet(ip: str) -> str:
    return f"CAST(string_split({ip}, '.')[4] AS INTEGER)"


oracle("cidr_whitelist", P, f"SELECT pkt_id, {last_octet('src_ip')} < 8 OR src_ip = '10.0.0.12' AS src_in, {last_octet('dst_ip')} < 8 OR dst_ip = '10.0.0.12' AS dst_in FROM packets")
oracle("cidr_join", P, f"""SELECT pkt_id, src_ip, network FROM packets JOIN (SELECT DISTINCT CAST(FLOOR({last_octet('dst_ip')} / 4) * 4 AS BIGINT) AS lo, 'net-' || CAST(167772160 + CAST(FLOOR({last_octet('dst_ip')} / 4) * 4 AS BIGINT) AS VARCHAR) AS network FROM packets)
ON {last_octet('src_ip')} BETWEEN lo AND lo + 3""")
CATEGORY = ("CASE " + " ".join(f"WHEN contains(lower(signature), '{s}') THEN '{n}'" for s, _, n in vocab.ALERT_CATEGORIES) + " WHEN severity <= 2 THEN 'Suspicious Activity' END")
oracle("alert_category", ("eve",), f"""SELECT event_no, signature, severity, {case_map('severity', vocab.SEVERITY_TEXT, "'Info'")} AS severity_text, {case_map('severity', vocab.SEVERITY_CLASS, "'alert-low'")} AS severity_class, {CATEGORY} AS attack_type FROM every_alert""", EVENTS)
BY_SEVERITY = "SELECT s AS severity, COUNT(b) AS n FROM (SELECT UNNEST([1, 2, 3, 4]) AS s) LEFT JOIN (SELECT GREATEST(1, LEAST(4, severity)) AS b FROM {src}) ON b = s GROUP BY s"
oracle("alerts_by_severity", ("eve",), BY_SEVERITY.format(src="every_alert"), EVENTS)


def top(ip: str, port: str, src: str) -> str:
    return f"SELECT {ip} || ':' || {port} AS endpoint, COUNT(*) AS n FROM {src} GROUP BY 1 ORDER BY n DESC, MIN(pkt_id) LIMIT 5"


oracle("protocol_counts", P, f"SELECT {PROTO_NAME} AS protocol, COUNT(*) AS n FROM packets GROUP BY 1")
oracle("top_sources", P, top("src_ip", "sport", "packets"))
oracle("top_destinations", P, top("dst_ip", "dport", "packets"))
oracle("recent_packets", P, "SELECT pkt_id, src_ip, dst_ip, length FROM packets ORDER BY ts_s DESC, pkt_id DESC LIMIT 100")
metric = lambda name, key, value, src: f"SELECT '{name}' AS metric, CAST({key} AS VARCHAR) AS \"key\", CAST({value} AS DOUBLE) AS \"value\" FROM ({src})"
LATEST = "SELECT * FROM packet_events ORDER BY ts_s DESC, pkt_id DESC LIMIT "
oracle("dashboard_snapshot", ("eve",), " UNION ALL ".join([
    metric("total_packets", "'all'", "n", "SELECT COUNT(*) AS n FROM packet_events"), metric("alert_count", "'all'", "n", "SELECT COUNT(*) AS n FROM packet_events WHERE is_alert"),
    metric("uptime", "'seconds'", "n", "SELECT MAX(ts_s) - MIN(ts_s) AS n FROM packet_events"), metric("protocols", "protocol", "n", "SELECT protocol, COUNT(*) AS n FROM packet_events GROUP BY 1"),
    metric("top_sources", "endpoint", "n", top("src_ip", "src_port", "packet_events")), metric("top_destinations", "endpoint", "n", top("dst_ip", "dst_port", "packet_events")),
    metric("alerts_by_severity", "severity", "n", BY_SEVERITY.format(src="packet_events WHERE is_alert")), metric("recent_packets", "pkt_id", "length", LATEST + "20"),
    metric("packet_sizes", "pkt_id", "length", LATEST + "50"), metric("recent_alerts", "pkt_id", "severity", LATEST.replace("ORDER", "WHERE is_alert ORDER") + "10")]), PACKET_EVENTS)
oracle("session_totals", P, f"""SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE NOT {DROPPED}) AS processed, COUNT(*) FILTER (WHERE {DROPPED}) AS dropped,
ROUND(COUNT(*) FILTER (WHERE {DROPPED}) * CAST(100 AS DOUBLE) / COUNT(*), 6) AS drop_pct, ROUND(MAX(ts_s) - MIN(ts_s), 6) AS elapsed, ROUND(COUNT(*) / (MAX(ts_s) - MIN(ts_s)), 6) AS pps FROM packets""")


def flow_class(expr: str) -> str:
    return case_map(expr, vocab.FLOW_CLASSES, f"'Unknown_Attack_' || {expr}")


oracle("latest_attack", ("predictions_multi",), f"""SELECT pkt_id, ts_s, attack_name, src, dst FROM (SELECT pkt_id, ts_s, {flow_class('predicted')} AS attack_name, src_ip || ':' || p.sport AS src, dst_ip || ':' || p.dport AS dst
FROM predictions_multi JOIN packets p USING (pkt_id) WHERE predicted <> 0 ORDER BY ts_s DESC, pkt_id DESC LIMIT 1) WHERE (SELECT MAX(ts_s) FROM packets) - ts_s < 10""")
oracle("detection_summary", ("predictions_multi",), f"SELECT {flow_class('predicted')} AS attack_name, COUNT(*) AS n FROM predictions_multi GROUP BY 1")
SHIFTED = "(predicted + CASE WHEN pkt_id % 50 = 0 THEN 10 ELSE 0 END)"
oracle("attack_names", ("predictions_multi",), f"SELECT pkt_id, CASE WHEN pkt_id % 61 = 0 THEN 'port scan' ELSE {flow_class(SHIFTED)} END AS attack_name FROM predictions_multi")
oracle("kdd_names", ("predictions_multi",), f"SELECT pkt_id, {case_map('predicted', dict(enumerate(vocab.KDD_CLASSES)), 'CAST(predicted AS VARCHAR)')} AS kdd_name FROM predictions_multi")
LOW_PORTS = ints(vocab.LOW_CONFIDENCE_PORTS)
WHITELIST = f"({DROPPED} AND proto IN (6, 17) AND (sport IN ({LOW_PORTS}) OR dport IN ({LOW_PORTS})))"
SAFE_SIDE = f"(sport IN ({SAFE}) OR dport IN ({SAFE}))"
oracle("prediction_gate", ("predictions_multi",), f"""SELECT pkt_id, CASE WHEN {WHITELIST} THEN 'benign_common_port' WHEN ({SAFE_SIDE} OR proto IN (1, 58)) AND confidence < 0.8 AND (sport IN ({LOW_PORTS}) OR dport IN ({LOW_PORTS})) THEN 'benign_whitelisted'
WHEN confidence < CASE WHEN predicted = 28 THEN 0.95 ELSE 0.7 END THEN 'benign_low_confidence' ELSE CAST(predicted AS VARCHAR) END AS outcome FROM predictions_multi""")
BENIGN_PRED = f"(predicted = 0 OR {SAFE_SIDE})"
oracle("alert_gate", ("predictions_multi",), f"""SELECT pkt_id, NOT {BENIGN_PRED} AND confidence > 0.7 AS is_attack, CASE WHEN {BENIGN_PRED} OR (predicted = 28 AND dport <> 5432 AND dport NOT BETWEEN 3306 AND 3400) THEN 'benign'
WHEN confidence < CASE WHEN predicted = 28 THEN 0.98 ELSE 0.85 END THEN 'below_threshold' ELSE 'alert' END AS outcome, CASE WHEN confidence < 0.9 THEN 'medium' ELSE 'high' END AS band FROM predictions_multi""")
oracle("outcome_counters", ("predictions_multi",), f"SELECT COUNT(*) FILTER (WHERE NOT {BENIGN_PRED} AND confidence > 0.7) AS malicious, COUNT(*) FILTER (WHERE {BENIGN_PRED}) AS benign, COUNT(*) FILTER (WHERE confidence < 0.7) AS unsure FROM predictions_multi")
oracle("benign_rule", P, f"SELECT pkt_id, {SAFE_SIDE} OR length < 100 OR proto IN (1, 58) AS benign, {WHITELIST} AS whitelisted FROM packets")
oracle("port_whitelist", P, f"SELECT pkt_id, dport IN ({ints(vocab.WHITELISTED_PORTS)}) AS whitelisted, dport IN ({COMMON}) AS common, {DROPPED} AS fast_path FROM packets")
oracle("port_select", P, "SELECT pkt_id, CASE pkt_id % 3 WHEN 0 THEN sport WHEN 1 THEN LEAST(65535, sport * 100) ELSE 0 END AS port FROM packets")
oracle("ip_only", ("mixed_packets",), "SELECT pkt_id, ip_version, CASE WHEN ip_version = 6 THEN CASE proto WHEN 6 THEN 'TCPv6' WHEN 17 THEN 'UDPv6' WHEN 58 THEN 'ICMPv6' ELSE 'Proto-' || proto END ELSE " + PROTO_NAME + " END AS protocol FROM mixed_packets WHERE ip_version IN (4, 6)")
oracle("capture_filter", ("mixed_packets",), "SELECT pkt_id FROM mixed_packets WHERE ip_version IN (4, 6) AND sport <> 22 AND dport <> 22")
oracle("service_lookup", P, f"SELECT pkt_id, {SERVICE_69.replace('proto IN (6, 17)', 'true')} AS service FROM packets")

# --- profiling and cleaning --------------------------------------------------------------
C = ("cic_flows",)
CLASSES = "classes AS (SELECT label, COUNT(*) AS n FROM {src} WHERE label IS NOT NULL GROUP BY label)"
CIC_CLASSES = CLASSES.format(src="cic_flows")
oracle("label_distribution", C, "SELECT * FROM classes", CIC_CLASSES)
oracle("label_only_scan", C, "SELECT * FROM classes", CIC_CLASSES)
oracle("head_sorted", C, "SELECT * FROM classes ORDER BY n DESC, label LIMIT 3", CIC_CLASSES)
oracle("label_distribution_cum", C, "SELECT label, n, pct, ROUND(SUM(pct) OVER (ORDER BY n DESC, label ROWS UNBOUNDED PRECEDING), 6) AS cum_pct FROM (SELECT *, round_even(n / CAST(SUM(n) OVER () AS DOUBLE) * 100, 2) AS pct FROM classes)", CIC_CLASSES)
oracle("class_stats", C, "SELECT COUNT(*) AS classes, CAST(SUM(n) AS BIGINT) AS total, MIN(n) AS min_n, MAX(n) AS max_n, ROUND(quantile_cont(n, 0.5), 6) AS median_n, ROUND(AVG(n), 6) AS mean_n, ROUND(MAX(n) / CAST(MIN(n) AS DOUBLE), 6) AS imbalance FROM classes", CIC_CLASSES)
oracle("suggested_cap", ("nslkdd",), """SELECT CAST(GREATEST(1000, LEAST(50000, CASE WHEN ratio > 100 THEN LEAST(base, FLOOR(med * 1.2)) ELSE base END)) AS BIGINT) AS suggested_max, ratio > 50 AS high_imbalance FROM (
SELECT med, ratio, CASE WHEN k > 10 THEN LEAST(FLOOR(med * 1.5), FLOOR(q60)) ELSE LEAST(50000, FLOOR(med)) END AS base FROM (SELECT COUNT(*) AS k, quantile_cont(n, 0.5) AS med, quantile_cont(n, 0.6) AS q60, MAX(n) / CAST(MIN(n) AS DOUBLE) AS ratio FROM classes))""",
       CLASSES.format(src="nslkdd").replace("label", "service"))
oracle("safe_cap", C, "SELECT CAST(s AS BIGINT) AS safe_max, CAST(s * k AS BIGINT) AS balanced_size, CAST(w AS BIGINT) AS weighted_size FROM (SELECT LEAST(FLOOR(MIN(n) * 0.8), 50000) AS s, COUNT(*) AS k, SUM(CASE WHEN n < 1000 THEN n ELSE LEAST(n, 10000) END) AS w FROM classes)", CIC_CLASSES)
NUMERIC_KDD = ["pkt_id", "src_bytes", "dst_bytes", "num_outbound_cmds", "difficulty"]
TEXT_KDD = ["protocol_type", "service", "flag", "label"]
oracle("profile_summary", ("nslkdd",), " UNION ALL ".join(
    [f"SELECT '{c}' AS column_name, COUNT({c}) AS n, ROUND(AVG({c}), 6) AS mean, ROUND(stddev_samp({c}), 6) AS std, CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max, CAST(NULL AS BIGINT) AS distinct_values FROM nslkdd" for c in NUMERIC_KDD]
    + [f"SELECT '{c}', COUNT({c}), NULL, NULL, NULL, NULL, COUNT(DISTINCT {c}) FROM nslkdd" for c in TEXT_KDD]))
oracle("header_clean", C, "SELECT label, SUM(flow_duration) AS flow_duration, ROUND(SUM(tot_byts), 2) AS tot_byts FROM cic_flows GROUP BY label")
FINITE = "CASE WHEN isfinite(flow_byts_s) THEN flow_byts_s END"
oracle("inf_to_null", C, f"SELECT l_orderkey, l_linenumber, tot_byts, {FINITE} AS flow_byts_s, idle_mean FROM cic_flows")
oracle("clean_flows", C, f"SELECT l_orderkey, l_linenumber, flow_duration, tot_byts, COALESCE({FINITE}, 0) AS flow_byts_s, COALESCE(idle_mean, 0) AS idle_mean, const_col, raw_num, label FROM cic_flows WHERE label IS NOT NULL")
oracle("median_impute", C, f"""SELECT l_orderkey, l_linenumber, flow_duration, COALESCE({FINITE}, (SELECT quantile_cont({FINITE}, 0.5) FROM cic_flows)) AS flow_byts_s, COALESCE(idle_mean, (SELECT quantile_cont(idle_mean, 0.5) FROM cic_flows)) AS idle_mean FROM cic_flows""")
oracle("numeric_coerce", C, "SELECT l_orderkey, l_linenumber, COALESCE(TRY_CAST(raw_num AS DOUBLE), 0) AS raw_num, COALESCE(idle_mean, 0) AS idle_mean FROM cic_flows")
oracle("missing_counts", C, f"SELECT * FROM (SELECT 'flow_byts_s' AS column_name, COUNT(*) - COUNT({FINITE}) AS missing FROM cic_flows UNION ALL SELECT 'idle_mean', COUNT(*) - COUNT(idle_mean) FROM cic_flows UNION ALL SELECT 'label', COUNT(*) - COUNT(label) FROM cic_flows) WHERE missing > 0")
oracle("duplicate_count", C, "SELECT CAST(SUM(n - 1) AS BIGINT) AS duplicates FROM (SELECT COUNT(*) AS n FROM cic_flows GROUP BY flow_duration, idle_mean, label)")
oracle("drop_columns", ("nslkdd",), "SELECT pkt_id, src_bytes, dst_bytes, protocol_type, service, flag, label FROM nslkdd")
oracle("drop_constant", C, "SELECT l_orderkey, l_linenumber, flow_duration, tot_byts, flow_byts_s, idle_mean, raw_num, label FROM cic_flows")
oracle("rare_services", ("nslkdd",), "SELECT pkt_id, CASE WHEN COUNT(*) OVER (PARTITION BY service) < 500 THEN 'rare' ELSE service END AS service FROM nslkdd")
KDD_PROTOCOLS = ["icmp", "tcp", "udp"]
KDD_SERVICES = ["domain_u", "ftp", "http", "https", "port_0", "port_31337", "port_3306", "port_4444", "port_5432", "port_8888", "smtp", "ssh"]
# services left at sf0.01 once those with fewer than 500 rows are collapsed
KDD_COLLAPSED = ["domain_u", "ftp", "http", "https", "port_0", "port_31337", "port_3306", "port_5432", "port_8888", "rare", "ssh"]
KDD_FLAGS = ["OTH", "REJ", "S0", "S1", "SH"]
oracle("one_hot_all", ("nslkdd",), f"SELECT pkt_id, src_bytes, dst_bytes, label, {one_hot('protocol_type', KDD_PROTOCOLS, 'protocol_type')}, {one_hot('service', KDD_SERVICES, 'service')}, {one_hot('flag', KDD_FLAGS, 'flag')} FROM nslkdd")
oracle("one_hot_vocab", P, f"SELECT pkt_id, {one_hot(PROTO_TEXT, vocab.PROTOCOLS_69, 'protocol_type')}, {one_hot(SERVICE_69, vocab.SERVICE_COLUMNS_69, 'service')}, {one_hot(EXACT, vocab.FLAG_COLUMNS_69, 'flag')} FROM packets")
oracle("label_standard", C, "SELECT l_orderkey, l_linenumber, flow_duration, upper(trim(label)) AS label FROM cic_flows")
oracle("label_binary", C, "SELECT CASE WHEN upper(trim(label)) IN ('BENIGN', 'NORMAL') THEN 'BENIGN' ELSE 'ATTACK' END AS label, COUNT(*) AS n FROM cic_flows GROUP BY 1")
oracle("typed_load", C, "SELECT l_orderkey, l_linenumber, TRY_CAST(flow_duration AS INTEGER) AS flow_duration, TRY_CAST(idle_mean AS FLOAT) AS idle_mean, TRY_CAST(raw_num AS TINYINT) AS raw_num, label FROM cic_flows")
RANGES = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(MIN({c}) AS BIGINT) AS lo, CAST(MAX({c}) AS BIGINT) AS hi FROM packets" for c in ("pkt_id", "proto", "sport", "dport", "length", "ttl", "tcp_flags", "tcp_window"))
oracle("type_ranges", P, f"""SELECT *, CASE WHEN lo >= 0 AND hi < 256 THEN 'smallint' WHEN lo >= 0 AND hi < 65536 THEN 'int' WHEN lo >= 0 THEN 'bigint' WHEN lo > -128 AND hi < 128 THEN 'tinyint' WHEN lo > -32768 AND hi < 32768 THEN 'smallint' ELSE 'int' END AS narrow_type FROM ({RANGES})
UNION ALL SELECT 'ts_s', NULL, NULL, 'float'""")
oracle("rename_columns", C, "SELECT l_orderkey, l_linenumber, flow_duration AS duration_s, tot_byts AS bytes_total, label FROM cic_flows")
oracle("min_class_filter", C, "SELECT label, COUNT(*) AS n FROM (SELECT CASE WHEN l_orderkey % 1009 = 5 THEN 'rare-' || l_orderkey ELSE label END AS label FROM cic_flows) WHERE label IS NOT NULL GROUP BY label HAVING COUNT(*) >= 4")
oracle("unseen_labels", ("cic_flows", "nslkdd"), "SELECT DISTINCT lower(trim(label)) AS label FROM cic_flows WHERE label IS NOT NULL AND lower(trim(label)) NOT IN (SELECT label FROM nslkdd)")
oracle("feature_diff", P, "SELECT sport AS port, 'source only' AS side FROM packets WHERE sport NOT IN (SELECT dport FROM packets) GROUP BY 1 UNION ALL SELECT port, 'either' FROM (SELECT sport AS port FROM packets UNION SELECT dport FROM packets)")
oracle("union_by_name", ("packets", "cic_flows"), "SELECT protocol, label, COUNT(*) AS n, ROUND(SUM(tot_byts), 2) AS bytes FROM (SELECT CAST(length AS DOUBLE) AS tot_byts, proto AS protocol, NULL AS label FROM packets UNION ALL SELECT tot_byts, NULL, label FROM cic_flows) GROUP BY 1, 2")

# --- encoding and preprocessing ----------------------------------------------------------
WEIGHT = "SUM(n) OVER () / CAST(COUNT(*) OVER () * n AS DOUBLE)"
oracle("class_weights", C, f"SELECT label, n, ROUND({WEIGHT}, 9) AS weight FROM classes", CIC_CLASSES)
oracle("weighted_rows", C, f"SELECT l_orderkey, l_linenumber, label, weight FROM cic_flows JOIN (SELECT label, ROUND({WEIGHT}, 9) AS weight FROM classes) USING (label)", CIC_CLASSES)
oracle("column_variance", ("nslkdd",), " UNION ALL ".join(f"SELECT '{c}' AS column_name, ROUND(var_pop({c}), 3) AS variance FROM nslkdd" for c in ("src_bytes", "dst_bytes", "num_outbound_cmds", "difficulty")))


def scaled(expr: str, src: str = "") -> str:
    return f"ROUND(({expr} - MIN({expr}) OVER ()) / CAST(MAX({expr}) OVER () - MIN({expr}) OVER () AS DOUBLE), 9)"


oracle("minmax_scale", ("nslkdd",), f"SELECT {scaled('src_bytes')} AS src_bytes, {scaled('dst_bytes')} AS dst_bytes, CAST(0 AS DOUBLE) AS num_outbound_cmds, {scaled('difficulty')} AS difficulty, label, {scaled('pkt_id')} AS pkt_id FROM nslkdd")
CODES = "codes AS (SELECT label AS raw, CAST(ROW_NUMBER() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT {l} AS label FROM {src} WHERE label IS NOT NULL))"
oracle("label_encode", C, "SELECT code AS label, COUNT(*) AS n FROM cic_flows JOIN codes ON raw = label GROUP BY 1", CODES.format(l="label", src="cic_flows"))
# columns whose population variance exceeds 0.1, in order: keys, duration, bytes, rate and raw_num
oracle("preprocess_flows", C, f"""SELECT {scaled('l_orderkey')} AS feature_0, {scaled('l_linenumber')} AS feature_1, {scaled('flow_duration')} AS feature_2, {scaled('tot_byts')} AS feature_3, {scaled('fb')} AS feature_4, {scaled('rn')} AS feature_5, code AS label FROM (
SELECT l_orderkey, l_linenumber, flow_duration, tot_byts, COALESCE({FINITE}, (SELECT quantile_cont({FINITE}, 0.5) FROM cic_flows WHERE label IS NOT NULL)) AS fb, COALESCE(TRY_CAST(raw_num AS DOUBLE), 0) AS rn, code FROM cic_flows JOIN codes ON raw = trim(label))""",
       CODES.format(l="trim(label)", src="cic_flows"))
oracle("preprocess_kdd", ("nslkdd",), f"SELECT {scaled('pkt_id')} AS pkt_id, {scaled('src_bytes')} AS src_bytes, {scaled('dst_bytes')} AS dst_bytes, code AS label, {one_hot('protocol_type', KDD_PROTOCOLS, 'protocol_type')}, {one_hot('service', KDD_COLLAPSED, 'service')}, {one_hot('flag', KDD_FLAGS, 'flag')} FROM slim JOIN codes ON raw = label",
       "slim AS (SELECT * REPLACE (CASE WHEN COUNT(*) OVER (PARTITION BY service) < 500 THEN 'rare' ELSE service END AS service) FROM nslkdd),\n" + CODES.format(l="label", src="nslkdd"))

# --- evaluation --------------------------------------------------------------------------
M = ("predictions_multi",)
oracle("confusion_matrix", M, "SELECT actual, predicted, n, ROUND(n / CAST(SUM(n) OVER (PARTITION BY actual) AS DOUBLE), 9) AS share FROM (SELECT actual, predicted, COUNT(*) AS n FROM predictions_multi GROUP BY 1, 2)")


def scores(src: str) -> str:
    return f"""(SELECT c AS class, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE CAST(0 AS DOUBLE) END AS f1, s AS support, h AS hit FROM (
SELECT c, CASE WHEN q > 0 THEN h / CAST(q AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS p, CASE WHEN s > 0 THEN h / CAST(s AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS r, s, h FROM (
SELECT c, (SELECT COUNT(*) FROM {src} WHERE predicted = c) AS q, (SELECT COUNT(*) FROM {src} WHERE actual = c) AS s, (SELECT COUNT(*) FROM {src} WHERE actual = c AND predicted = c) AS h
FROM (SELECT actual AS c FROM {src} UNION SELECT predicted FROM {src}))))"""


MACRO = "SUM(hit) / CAST(SUM(support) AS DOUBLE) AS accuracy, AVG(precision) AS precision, AVG(recall) AS recall, AVG(f1) AS f1_score"
oracle("macro_metrics", M, f"SELECT ROUND(accuracy, 9) AS accuracy, ROUND(precision, 9) AS precision, ROUND(recall, 9) AS recall, ROUND(f1_score, 9) AS f1_score FROM (SELECT {MACRO} FROM {scores('predictions_multi')})")
B = ("predictions",)
oracle("classification_report", B, f"""SELECT CAST(class AS VARCHAR) AS class, ROUND(precision, 9) AS precision, ROUND(recall, 9) AS recall, ROUND(f1, 9) AS f1, support FROM scored
UNION ALL SELECT 'macro avg', ROUND(AVG(precision), 9), ROUND(AVG(recall), 9), ROUND(AVG(f1), 9), CAST(SUM(support) AS BIGINT) FROM scored
UNION ALL SELECT 'weighted avg', ROUND(SUM(precision * support) / SUM(support), 9), ROUND(SUM(recall * support) / SUM(support), 9), ROUND(SUM(f1 * support) / SUM(support), 9), CAST(SUM(support) AS BIGINT) FROM scored""", f"scored AS {scores('predictions')}")
CURVE = """curve AS (SELECT score AS threshold, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER () AS p, SUM(neg) OVER () AS ng FROM (
SELECT score, COUNT(*) FILTER (WHERE actual = 1) AS pos, COUNT(*) FILTER (WHERE actual <> 1) AS neg FROM predictions GROUP BY score) WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
# area as the share of (positive, negative) pairs in the right order, ties half
oracle("roc_auc", B, "SELECT ROUND(AVG(CASE WHEN a.score > b.score THEN CAST(1 AS DOUBLE) WHEN a.score = b.score THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 9) AS auc FROM predictions a, predictions b WHERE a.actual = 1 AND b.actual <> 1")
oracle("roc_curve", B, "SELECT ROUND(threshold, 9) AS threshold, ROUND(fp / CAST(ng AS DOUBLE), 9) AS fpr, ROUND(tp / CAST(p AS DOUBLE), 9) AS tpr FROM curve", CURVE)
oracle("pr_curve", B, "SELECT ROUND(threshold, 9) AS threshold, ROUND(tp / CAST(tp + fp AS DOUBLE), 9) AS precision, ROUND(tp / CAST(p AS DOUBLE), 9) AS recall FROM curve", CURVE)
oracle("average_precision", B, "SELECT ROUND(SUM((tp - before) / CAST(p AS DOUBLE) * tp / CAST(tp + fp AS DOUBLE)), 9) AS average_precision FROM (SELECT *, COALESCE(LAG(tp) OVER (ORDER BY threshold DESC), 0) AS before FROM curve)", CURVE)
MODELS = ", ".join(f"m{i} AS (SELECT actual, CAST(CASE WHEN score >= {c} THEN 1 ELSE 0 END AS INTEGER) AS predicted FROM predictions)" for i, c in enumerate((0.2, 0.4, 0.6, 0.8)))
BOARD = MODELS + ", board AS (" + " UNION ALL ".join(f"SELECT 'cut_{c}' AS model_name, ROUND(accuracy, 9) AS accuracy, ROUND(precision, 9) AS precision, ROUND(recall, 9) AS recall, ROUND(f1_score, 9) AS f1_score FROM (SELECT {MACRO} FROM {scores(f'm{i}')})" for i, c in enumerate((0.2, 0.4, 0.6, 0.8))) + ")"
oracle("leaderboard", B, "SELECT * FROM board", BOARD)
oracle("model_comparison", B, " UNION ALL ".join(f"SELECT model_name, '{m}' AS metric, {m} AS \"value\", CAST(DENSE_RANK() OVER (ORDER BY {m} DESC) AS INTEGER) AS place FROM board" for m in ("accuracy", "precision", "recall", "f1_score")), BOARD)
oracle("majority_fallback", M, "SELECT pkt_id, CASE WHEN predicted IN (SELECT actual FROM predictions_multi WHERE actual < 20) THEN predicted ELSE (SELECT actual FROM predictions_multi WHERE actual < 20 GROUP BY actual ORDER BY COUNT(*) DESC, actual LIMIT 1) END AS predicted FROM predictions_multi")

# --- sampling and balancing --------------------------------------------------------------
oracle("split_counts", C, "SELECT label, t.is_test, CASE WHEN t.is_test THEN CAST(ROUND(n * 0.2) AS BIGINT) ELSE n - CAST(ROUND(n * 0.2) AS BIGINT) END AS n FROM classes, (SELECT UNNEST([true, false]) AS is_test) t", CIC_CLASSES)
oracle("cap_counts", C, "SELECT label, LEAST(n, 1500) AS n FROM classes", CIC_CLASSES)
oracle("sample_counts", C, "SELECT label, LEAST(n, CAST(FLOOR(5000 / COUNT(*) OVER ()) AS BIGINT)) AS n FROM classes", CIC_CLASSES)
oracle("sample_fraction_counts", C, "SELECT label, CAST(round_even(n * CAST(0.1 AS DOUBLE), 0) AS BIGINT) AS n FROM classes", CIC_CLASSES)
oracle("plain_sample_count", C, "SELECT LEAST(COUNT(*), 2500) AS n FROM cic_flows")
UNEVEN = "uneven AS (SELECT CASE WHEN label < 6 THEN 0 ELSE label END AS label FROM embeddings)"
oracle("smote_counts", (), "SELECT DISTINCT label, (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM uneven GROUP BY label)) AS n FROM uneven", UNEVEN)
oracle("smote_batch_faithful", C, "SELECT label, CASE WHEN n = MAX(n) OVER () THEN n ELSE 2 * n END AS n FROM classes", CIC_CLASSES)


def distance(metric: str) -> str:
    if metric == "manhattan":
        return "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE))))"
    return "sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) ** 2)))"


def near(metric: str, k: int, condition: str) -> str:
    return f"""near AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, b.label AS vote, {distance(metric)} AS d FROM embeddings a JOIN embeddings b ON {condition}),
top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY d, neighbour_id) AS rn FROM near QUALIFY rn <= {k})"""


oracle("knn_neighbours", (), "SELECT query_id, neighbour_id, CAST(rn AS INTEGER) AS rank, ROUND(d, 6) AS distance FROM top", near("euclidean", 5, "a.label = b.label AND a.vec_id <> b.vec_id"))
SPLIT = "a.vec_id % 4 = 0 AND b.vec_id % 4 <> 0"
oracle("knn_classify", (), "SELECT query_id AS vec_id, vote AS predicted FROM (SELECT query_id, vote, COUNT(*) AS w FROM top GROUP BY 1, 2) QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY w DESC, vote) = 1", near("euclidean", 5, SPLIT))
oracle("knn_classify_weighted", (), "SELECT query_id AS vec_id, vote AS predicted FROM (SELECT query_id, vote, SUM(1 / d) AS w FROM top GROUP BY 1, 2) QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY w DESC, vote) = 1", near("manhattan", 7, SPLIT))

# --- files -------------------------------------------------------------------------------
F_ = ("capture_files",)
oracle("file_labels", F_, "SELECT pkt_id, file_name, string_split(file_name, '_')[1] AS label FROM capture_files")
oracle("prefix_join", F_, f"SELECT pkt_id, file_name, label FROM capture_files JOIN (SELECT UNNEST([{quoted(vocab.CAPTURE_PREFIXES)}]) AS label) ON starts_with(file_name, label) AND suffix(file_name, '.csv')")
oracle("scan_projected", (), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
oracle("scan_multi_format", P, "SELECT pkt_id, src_ip, length, CASE WHEN proto = 6 THEN tcp_flags END AS tcp_flags FROM packets")
oracle("scan_parquet", (), " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n FROM {t}" for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()))

# --- streams -----------------------------------------------------------------------------
ORACLES["stream_throughput_2s"] = ORACLES["throughput_2s"]
oracle("stream_flood_10s", P, """SELECT window_start, COUNT(*) / CAST(10 AS DOUBLE) AS pps FROM (SELECT UNNEST(range(CAST(FLOOR(ts_s) AS BIGINT) - 9, CAST(FLOOR(ts_s) AS BIGINT) + 1)) AS window_start FROM packets)
GROUP BY 1 HAVING COUNT(*) > 30""")
ORACLES["stream_flow_sessions"] = "SELECT * EXCLUDE (session_no) FROM (" + ORACLES["flow_sessions"] + ")"
ORACLES["stream_scan_classifier"] = ORACLES["scan_classifier"]
ORACLES["stream_flow_running"] = reset_ctes(["src_ip", "proto"]) + """ SELECT p.pkt_id, p.src_ip, p.proto, COUNT(*) OVER w AS flow_packets, CAST(SUM(length) OVER w AS BIGINT) AS flow_bytes, p.ts_s - FIRST_VALUE(p.ts_s) OVER w AS flow_duration,
p.ts_s - LAG(p.ts_s) OVER (PARTITION BY p.src_ip, p.proto ORDER BY p.ts_s, p.pkt_id) AS iat, k.flow_packet_count AS segment_packets, k.ts_s - k.origin AS segment_duration
FROM packets p JOIN walk k USING (pkt_id) WINDOW w AS (PARTITION BY p.src_ip, p.proto ORDER BY p.ts_s, p.pkt_id ROWS UNBOUNDED PRECEDING)"""
ORACLES["stream_rate_limit"] = ORACLES["rate_limit"]
oracle("stream_decisions", P, f"SELECT pkt_id, CASE WHEN ROW_NUMBER() OVER (PARTITION BY {FIVE} ORDER BY ts_s, pkt_id) > 1 THEN 'cached_benign' ELSE 'common_port' END AS decision FROM packets WHERE {DROPPED}")
ORACLES["stream_alert_ingest"] = ORACLES["alert_normalise"]
oracle("stream_alert_fusion", ("eve",), "SELECT pkt_id, tier, event_no FROM best", FUSED)
ORACLES["stream_dashboard"] = ORACLES["dashboard_snapshot"]
ORACLES["stream_predictions_30s"] = ORACLES["predictions_30s"]
ORACLES["stream_packet_events"] = ORACLES["packet_events"]
oracle("boosted_classes", P, "SELECT pkt_id, CASE WHEN proto = 1 THEN 0 WHEN proto = 17 THEN 1 WHEN dport < 100 THEN 2 ELSE 3 END AS predicted FROM packets WHERE pkt_id % 7 = 0")
