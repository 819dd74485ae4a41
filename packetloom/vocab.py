"""Fixed values. They have to equal the published ones for results to be right."""

# --- class names -------------------------------------------------------------------------
# Flow-model class id -> name.
FLOW_CLASSES = {
    0: "Benign",
    1: "FTP-Patator",
    2: "SSH-Patator",
    3: "DoS Hulk",
    4: "DoS GoldenEye",
    5: "DoS slowloris",
    6: "DoS Slowhttptest",
    7: "Heartbleed",
    8: "Web Attack - Brute Force",
    9: "Web Attack - XSS",
    10: "Web Attack - Sql Injection",
    11: "Infiltration",
    12: "Bot",
    13: "PortScan",
    14: "DDoS",
    15: "Brute Force -Web",
    16: "Brute Force -XSS",
    17: "SQL Injection",
    18: "FTP-BruteForce",
    19: "SSH-BruteForce",
    20: "DoS attacks-SlowHTTPTest",
    21: "DoS attacks-Hulk",
    22: "DoS attacks-Slowloris",
    23: "DoS attacks-GoldenEye",
    24: "DDOS attack-LOIC-HTTP",
    25: "DDOS attack-HOIC",
    26: "DDOS attack-LOIC-UDP",
    27: "MSSQL",
    28: "PostgreSQL",
    29: "Apache",
    30: "IIS",
    31: "Nginx",
    32: "Lighttpd",
}

# Connection-model (NSL-KDD) class names; the id is the position.
KDD_CLASSES = [
    "back", "buffer_overflow", "ftp_write", "guess_passwd", "imap", "ipsweep", "land",
    "loadmodule", "multihop", "neptune", "nmap", "normal", "perl", "phf", "pod", "portsweep",
    "rootkit", "satan", "smurf", "spy", "teardrop", "warezclient", "warezmaster",
]

# File-name prefix -> label for captured attack files.
CAPTURE_PREFIXES = ["neptune", "smurf", "teardrop", "back", "pod", "land", "ipsweep", "portsweep"]

# --- ports -------------------------------------------------------------------------------
# Ports treated as everyday services by the fast path.
COMMON_PORTS = [
    21, 22, 23, 25, 53, 67, 68, 69, 80, 110, 123, 137, 138, 139, 143, 161, 162, 389, 443, 445,
    465, 514, 515, 548, 587, 631, 636, 993, 995, 1025, 1026, 1027, 1028, 1029, 1080, 1194, 1433,
    1434, 1521, 1701, 1723, 1900, 2049, 2082, 2083, 2086, 2087, 2095, 2096, 3000, 3128, 3306,
    3389, 4000, 4040, 4369, 4500, 4567, 4711, 4712, 5000, 5001, 5002, 5003, 5004, 5005, 5060,
    5104, 5106, 5222, 5223, 5228, 5353, 5432, 5601, 5672, 5900, 5938, 5984, 6000, 6379, 6666,
    7000, 7077, 7474, 7547, 7575, 8000, 8005, 8008, 8009, 8020, 8042, 8069, 8080, 8081, 8083,
    8088, 8089, 8090, 8091, 8095, 8096, 8100, 8140, 8172, 8181, 8200, 8243, 8280, 8281, 8333,
    8400, 8443, 8500, 8530, 8531, 8880, 8888, 8983, 9000, 9001, 9002, 9042, 9060, 9080, 9090,
    9091, 9092, 9100, 9140, 9160, 9200, 9300, 9418, 9443, 9600, 9800, 9981, 10000, 10250, 10255,
    10443, 11080, 11371, 12018, 12046, 12443, 14000, 16000, 16992, 16993, 18080, 18081, 18091,
    18092, 20000, 27017, 27018, 27019, 28017, 32400, 32768, 35357, 44818, 47001, 47002, 47808,
    49152, 49153, 49154, 49155, 49156, 49157, 50000, 50010, 50020, 50030, 50060, 50070, 50075,
    50090, 54321, 56000, 56789, 60000, 60010, 60030, 61616, 62078, 64738,
]

# Port groups of the rules.
SAFE_PORTS = [53, 67, 68, 80, 123, 443, 8000, 8008, 8080, 8081, 8088, 8443, 8888, 9000]
WHITELISTED_PORTS = [53, 80, 123, 443]
LOW_CONFIDENCE_PORTS = [22, 53, 80, 443]
LOGIN_PORTS = [21, 22, 23, 25, 110, 143, 445, 993, 995]
COMMON_SERVICE_PORTS = [
    20, 21, 22, 69, 115, 161, 162, 389, 443, 445, 636, 989, 990, 992, 993, 995, 1433, 1521, 2049,
    3306, 3389, 5432, 5800, 5900, 6000, 8000, 8080, 8443, 8888,
]
WHITELISTED_NETWORKS = ["127.0.0.1/32", "::1/128"]

# Port -> service, for the 47-column and the 69-column feature sets.
SERVICES_47 = {20: "ftp", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "domain",
               69: "tftp", 80: "http", 110: "pop3", 143: "imap", 443: "https"}
SERVICES_69 = {20: "ftp_data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "domain_u",
               69: "tftp", 80: "http", 110: "pop3", 143: "imap", 443: "https"}
# Service names used in the flow aggregate (ports below 1024 only).
FLOW_SERVICES = {80: "http", 443: "https", 22: "ssh", 21: "ftp", 25: "smtp", 53: "dns"}
# Registered service names (IANA) looked up after the fixed tables.
REGISTERED_SERVICES = {
    7: "echo", 9: "discard", 13: "daytime", 37: "time", 43: "whois", 49: "tacacs", 67: "bootps",
    68: "bootpc", 70: "gopher", 79: "finger", 88: "kerberos", 111: "sunrpc", 113: "auth",
    119: "nntp", 123: "ntp", 135: "epmap", 137: "netbios-ns", 138: "netbios-dgm",
    139: "netbios-ssn", 161: "snmp", 162: "snmp-trap", 179: "bgp", 194: "irc", 389: "ldap",
    445: "microsoft-ds", 465: "submissions", 514: "syslog", 515: "printer", 543: "klogin",
    548: "afpovertcp", 554: "rtsp", 587: "submission", 631: "ipp", 636: "ldaps", 873: "rsync",
    989: "ftps-data", 990: "ftps", 992: "telnets", 993: "imaps", 995: "pop3s", 1080: "socks",
    1194: "openvpn", 1433: "ms-sql-s", 2049: "nfs", 3306: "mysql", 3389: "ms-wbt-server",
    5060: "sip", 5061: "sip-tls", 5222: "xmpp-client", 5269: "xmpp-server", 5353: "mdns",
    5432: "postgresql", 5672: "amqp", 6379: "redis", 8080: "http-alt",
}
DEFAULT_SERVICE = "other"

# --- one-hot vocabularies ----------------------------------------------------------------
# Column order of the one-hot blocks.
PROTOCOLS_47 = ["icmp", "tcp", "udp"]
PROTOCOLS_69 = ["tcp", "udp", "icmp"]
SERVICE_COLUMNS_47 = ["ftp", "ssh", "telnet", "smtp", "domain", "tftp", "http", "pop3", "imap",
                      "https", "other", "rare"]
SERVICE_COLUMNS_69 = ["domain_u", "eco_i", "ecr_i", "finger", "ftp", "ftp_data", "http", "other",
                      "private", "rare", "smtp", "telnet"]
FLAG_COLUMNS_47 = ["S0", "S1", "SF", "S2", "REJ", "RSTR", "SH", "OTH"]
FLAG_COLUMNS_69 = ["OTH", "REJ", "RSTO", "RSTOS0", "RSTR", "S0", "S1", "S2", "S3", "SF", "SH"]
# TCP flag bit -> name.
TCP_BITS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32, "ECE": 64, "CWR": 128}
# Exact flag byte -> connection flag.
EXACT_FLAGS = {2: "S0", 18: "S1", 20: "REJ", 4: "RSTR", 1: "SF", 17: "S2", 3: "SH"}

# Constant columns of the 69-column record.
ZERO_FIELDS_69 = ["wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in",
                  "num_compromised", "root_shell", "su_attempted", "num_root",
                  "num_file_creations", "num_shells", "num_access_files", "is_host_login",
                  "is_guest_login"]
COUNT_FIELDS_69 = ["count", "srv_count", "dst_host_count", "dst_host_srv_count"]
ZERO_RATES_69 = ["serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate",
                 "diff_srv_rate", "srv_diff_host_rate", "dst_host_diff_srv_rate",
                 "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate",
                 "dst_host_serror_rate", "dst_host_srv_serror_rate", "dst_host_rerror_rate",
                 "dst_host_srv_rerror_rate"]
ONE_RATES_69 = ["same_srv_rate", "dst_host_same_srv_rate"]

# Input columns of the connection model, in order.
KDD_MODEL_COLUMNS = [
    "duration", "src_bytes", "dst_bytes", "land", "wrong_fragment", "urgent", "hot",
    "num_failed_logins", "logged_in", "num_compromised", "root_shell", "su_attempted", "num_root",
    "num_file_creations", "num_shells", "num_access_files", "is_host_login", "is_guest_login",
    "count", "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate",
    "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count",
    "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
    "protocol_type_icmp", "protocol_type_tcp", "protocol_type_udp", "service_domain_u",
    "service_eco_i", "service_ecr_i", "service_finger", "service_ftp", "service_ftp_data",
    "service_http", "service_other", "service_private", "service_rare", "service_smtp",
    "service_telnet", "flag_OTH", "flag_REJ", "flag_RSTO", "flag_RSTOS0", "flag_RSTR", "flag_S0",
    "flag_S1", "flag_S2", "flag_S3", "flag_SF", "flag_SH",
]

# --- payload rules -----------------------------------------------------------------------
# HTTP payload classes; the first class with a pattern in the text wins.
HTTP_PATTERNS = {
    "SQL_INJECTION": ["' or '1'='1", "union select", "drop table", "select * from"],
    "XSS": ["<script>", "javascript:", "onerror=", "alert("],
    "LFI": ["../../", "/etc/passwd", "win.ini", "boot.ini"],
    "COMMAND_INJECTION": [";ls", "|cat ", "`id`", "$(whoami)"],
    "DIRECTORY_TRAVERSAL": ["../", "..%2f", "..\\", "%2e%2e/"],
}
# DNS name keywords.
DNS_KEYWORDS = ["tunnel", "exfil", "malware", "command", "c2", "cnc"]
# Shellcode byte sequences (hex).
NOP_SEQUENCES = ["90" * 8, "0F1F4000"]
SHELLCODE_ENTROPY = 6.5

# --- alerts ------------------------------------------------------------------------------
# Severity text, and keyword -> category (signature keyword, category keyword).
SEVERITY_TEXT = {1: "Critical", 2: "High", 3: "Medium", 4: "Low"}
SEVERITY_CLASS = {1: "alert-critical", 2: "alert-high", 3: "alert-medium"}
ALERT_CATEGORIES = [
    ("sql", "sql", "SQL Injection"),
    ("xss", "xss", "XSS Attack"),
    ("bruteforce", "bruteforce", "Brute Force"),
    ("portscan", "scan", "Port Scan"),
    ("dos", "dos", "DoS Attempt"),
]
BENIGN_LABELS = ["benign", "normal", "0", "prediction_error", "error", "unknown"]

# --- flow table --------------------------------------------------------------------------
# Compact column types of the labelled flow table.
FLOW_TABLE_TYPES = {
    "int": [
        "src_port", "dst_port", "flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "fwd_header_len",
        "bwd_header_len", "subflow_fwd_pkts", "subflow_fwd_byts", "subflow_bwd_pkts",
        "subflow_bwd_byts", "init_fwd_win_byts", "init_bwd_win_byts", "fwd_act_data_pkts",
    ],
    "tinyint": [
        "protocol", "fwd_psh_flags", "bwd_psh_flags", "fwd_urg_flags", "bwd_urg_flags",
        "fin_flag_cnt", "syn_flag_cnt", "rst_flag_cnt", "psh_flag_cnt", "ack_flag_cnt",
        "urg_flag_cnt", "cwe_flag_count", "ece_flag_cnt",
    ],
    "float": [
        "totlen_fwd_pkts", "totlen_bwd_pkts", "fwd_pkt_len_max", "fwd_pkt_len_min",
        "fwd_pkt_len_mean", "fwd_pkt_len_std", "bwd_pkt_len_max", "bwd_pkt_len_min",
        "bwd_pkt_len_mean", "bwd_pkt_len_std", "flow_byts_s", "flow_pkts_s", "flow_iat_mean",
        "flow_iat_std", "flow_iat_max", "flow_iat_min", "fwd_iat_tot", "fwd_iat_mean",
        "fwd_iat_std", "fwd_iat_max", "fwd_iat_min", "bwd_iat_tot", "bwd_iat_mean", "bwd_iat_std",
        "bwd_iat_max", "bwd_iat_min", "fwd_pkts_s", "bwd_pkts_s", "pkt_len_min", "pkt_len_max",
        "pkt_len_mean", "pkt_len_std", "pkt_len_var", "down_up_ratio", "pkt_size_avg",
        "fwd_seg_size_avg", "bwd_seg_size_avg", "fwd_byts_b_avg", "fwd_pkts_b_avg",
        "fwd_blk_rate_avg", "bwd_byts_b_avg", "bwd_pkts_b_avg", "bwd_blk_rate_avg",
        "fwd_seg_size_min", "active_mean", "active_std", "active_max", "active_min", "idle_mean",
        "idle_std", "idle_max", "idle_min",
    ],
    "string": ["label"],
}
