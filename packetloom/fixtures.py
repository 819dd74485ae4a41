"""Views over the given tables that stand in for packets, alerts and labelled flows.

The same text runs on Spark and, with STRING spelled VARCHAR, on DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# view -> (table or view it reads, text)
VIEWS = {
    "packets": ("events", r"""
SELECT event_id AS pkt_id,
  CAST(event_id * 0.25 + FLOOR(event_id / 500) * 120 + FLOOR(event_id / 2500) * 400 AS DOUBLE) AS ts_s,
  CONCAT('10.0.0.', CAST(user_id % 20 AS STRING)) AS src_ip,
  CONCAT('10.0.0.', CAST(CASE WHEN user_id % 20 < 7
      THEN ((user_id % 20) * 7 + CAST(FLOOR(event_id / 500) AS BIGINT)) % 20
      ELSE (user_id * 7 + event_id) % 20 END AS STRING)) AS dst_ip,
  CAST(CASE WHEN event_id % 10 = 0 THEN 1 WHEN event_id % 10 IN (1, 2) THEN 17 ELSE 6 END AS INT) AS proto,
  CAST(CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1024 + (user_id % 20) * 13 END AS INT) AS sport,
  CAST(CASE WHEN event_id % 10 = 0 THEN 0 WHEN user_id % 20 BETWEEN 7 AND 13 THEN 22
    ELSE CASE (event_id + user_id) % 11 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 53
      WHEN 4 THEN 21 WHEN 5 THEN 25 WHEN 6 THEN 3306 WHEN 7 THEN 5432 WHEN 8 THEN 8888
      WHEN 9 THEN 31337 ELSE 4444 END END AS INT) AS dport,
  CAST(40 + (event_id * 37) % 1460 AS INT) AS length,
  CAST(CASE event_id % 3 WHEN 0 THEN 64 WHEN 1 THEN 128 ELSE 255 END AS INT) AS ttl,
  CAST(CASE WHEN event_id % 10 IN (0, 1, 2) THEN 0 WHEN event_id % 97 = 0 THEN 3
    WHEN event_id % 89 = 0 THEN 19 WHEN event_id % 83 = 0 THEN 6
    WHEN event_type = 'click' THEN 2 WHEN event_type = 'view' THEN 16 WHEN event_type = 'error' THEN 20
    WHEN event_type = 'purchase' THEN 24 ELSE 18 END AS INT) AS tcp_flags,
  CAST(CASE WHEN event_id % 10 IN (0, 1, 2) OR event_id % 50 = 3 THEN 0 ELSE (event_id * 53) % 65536 END AS INT) AS tcp_window,
  CASE event_id % 50 WHEN 7 THEN '/q?id=1 UNION SELECT name' WHEN 14 THEN '<script>alert(1)</script>'
    WHEN 23 THEN '/f?p=../../etc/passwd' WHEN 31 THEN '/c?x=1|cat /tmp/a' WHEN 38 THEN '/d?p=..%2fetc'
    ELSE props END AS payload,
  CASE WHEN event_id % 10 IN (1, 2) THEN CASE event_id % 50 WHEN 11 THEN 'a.tunnel.example.com'
    WHEN 21 THEN 'x1234567.example.com'
    WHEN 31 THEN 'aaaaaaaaaabbbbbbbbbbccccccccccddddddddddeeeeeeeeee.example.com'
    ELSE 'www.example.com' END END AS dns_query
FROM events
"""),
    "eve": ("packets", r"""
SELECT pkt_id AS event_no, ts_s,
  CASE WHEN pkt_id % 1000 = 999 THEN '{broken'
  WHEN pkt_id % 25 = 0 THEN CONCAT('{"event_type":"flow","src_ip":"', src_ip, '","dest_ip":"', dst_ip,
    '","flow":{"alerted":', CASE WHEN pkt_id % 50 = 0 THEN 'true' ELSE 'false' END, '}}')
  ELSE CONCAT('{"event_type":"alert","src_ip":"', src_ip, '","dest_ip":"', dst_ip,
    '","alert":{"signature":"', CASE pkt_id % 5 WHEN 0 THEN 'ET SQL probe' WHEN 1 THEN 'XSS attempt'
      WHEN 2 THEN 'ssh bruteforce' WHEN 3 THEN 'portscan' ELSE 'dos flood' END,
    '","severity":', CAST(pkt_id % 6 AS STRING), ',"signature_id":', CAST(2000000 + pkt_id % 7 AS STRING), '}}') END AS line
FROM packets
WHERE pkt_id % 25 = 0 OR pkt_id % 1000 = 999 OR ((CAST(FLOOR(tcp_flags / 4) AS INT)) % 2 = 1 AND pkt_id % 4 = 0)
"""),
    "cic_flows": ("lineitem", r"""
SELECT l_orderkey, l_linenumber, l_quantity AS flow_duration, l_extendedprice AS tot_byts,
  CASE WHEN l_discount = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_tax / l_discount END AS flow_byts_s,
  CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS idle_mean,
  CAST(1 AS DOUBLE) AS const_col,
  CASE WHEN l_partkey % 50 = 0 THEN 'n/a' ELSE CAST(l_partkey % 300 AS STRING) END AS raw_num,
  CASE WHEN l_orderkey % 100 < 80 THEN ' Benign ' WHEN l_orderkey % 100 < 90 THEN 'DoS Hulk'
    WHEN l_orderkey % 100 < 97 THEN 'portscan' WHEN l_orderkey % 100 < 99 THEN 'NORMAL' ELSE NULL END AS label
FROM lineitem
"""),
    "nslkdd": ("packets", r"""
SELECT pkt_id, length AS src_bytes, tcp_window AS dst_bytes, 0 AS num_outbound_cmds,
  CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE 'icmp' END AS protocol_type,
  CASE dport WHEN 80 THEN 'http' WHEN 22 THEN 'ssh' WHEN 53 THEN 'domain_u' WHEN 21 THEN 'ftp'
    WHEN 25 THEN 'smtp' WHEN 443 THEN 'https' ELSE CONCAT('port_', CAST(dport AS STRING)) END AS service,
  CASE tcp_flags WHEN 2 THEN 'S0' WHEN 18 THEN 'S1' WHEN 20 THEN 'REJ' WHEN 4 THEN 'RSTR'
    WHEN 1 THEN 'SF' WHEN 17 THEN 'S2' WHEN 3 THEN 'SH' ELSE 'OTH' END AS flag,
  CASE WHEN pkt_id % 10 < 6 THEN 'normal' WHEN pkt_id % 10 < 8 THEN 'neptune'
    WHEN pkt_id % 10 = 8 THEN 'portsweep' ELSE 'smurf' END AS label,
  CAST(pkt_id % 21 AS INT) AS difficulty
FROM packets
"""),
    "predictions": ("labels", r"""
SELECT doc_id, CAST(quality AS INT) AS actual, CAST(CASE WHEN doc_id * 37 % 101 >= 40 THEN 1 ELSE 0 END AS INT) AS predicted,
  CAST(doc_id * 37 % 101 AS DOUBLE) / CAST(101 AS DOUBLE) AS score
FROM labels
"""),
    "predictions_multi": ("packets", r"""
SELECT pkt_id, sport, dport, proto, CAST(pkt_id % 33 AS INT) AS actual,
  CAST(CASE WHEN pkt_id % 7 = 0 THEN (pkt_id + 1) % 33 ELSE pkt_id % 33 END AS INT) AS predicted,
  CAST(50 + (pkt_id * 29) % 51 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
FROM packets
"""),
    # packets with a link-layer share: every 40th row is not IP, every 13th is IPv6
    "mixed_packets": ("packets", r"""
SELECT *, CAST(CASE WHEN pkt_id % 40 = 39 THEN 0 WHEN pkt_id % 13 = 0 THEN 6 ELSE 4 END AS INT) AS ip_version
FROM packets
"""),
    # one row per capture file written for a packet burst
    "capture_files": ("packets", r"""
SELECT pkt_id, length, CONCAT(CASE pkt_id % 12 WHEN 0 THEN 'neptune' WHEN 1 THEN 'smurf' WHEN 2 THEN 'teardrop'
    WHEN 3 THEN 'back' WHEN 4 THEN 'pod' WHEN 5 THEN 'land' WHEN 6 THEN 'ipsweep' WHEN 7 THEN 'portsweep'
    WHEN 8 THEN 'udp_flood' WHEN 9 THEN 'syn_ack_flood' WHEN 10 THEN 'xmas_scan' ELSE 'http_get_flood' END,
    '_', CAST(pkt_id AS STRING), CASE WHEN pkt_id % 31 = 0 THEN '.txt' ELSE '.csv' END) AS file_name
FROM packets
"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view (or, for other names, the given table) as a DataFrame."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    base, text = VIEWS[name]
    # the view text names its input; bind that name to the DataFrame without a temp view
    bound = text.replace(f"FROM {base}", "FROM {source}")
    if "{broken" in bound or '{"' in bound:  # JSON braces are literal text
        bound = bound.replace("{", "{{").replace("}", "}}").replace("{{source}}", "{source}")
    return spark.sql(bound, source=view(spark, sf_dir, base))


def duckdb_text(name: str) -> str:
    """The view as DuckDB SQL."""
    return VIEWS[name][1].replace("AS STRING", "AS VARCHAR").strip()


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the named views and those they read, inputs first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in ordered:
            add(VIEWS[name][0])
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({duckdb_text(n)})" for n in ordered)
