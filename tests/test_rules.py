"""Column rules at their boundaries: each fires and stays silent."""

import pytest
from pyspark.sql import functions as F

from packetloom.functions import packets as P
from packetloom.functions import payload as B
from packetloom.functions import verdicts as V
from packetloom.operators import cleaning, lookups


def values(spark, rows, schema, build):
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, " + schema)
    return [r["v"] for r in table.select("n", build().alias("v")).orderBy("n").collect()]


def test_http_class_takes_the_first_class(spark):
    rows = [("a UNION SELECT b",), ("<script> union select",), ("../../x",), ("../x",), ("|cat x",), ("|catx",), (None,)]
    assert values(spark, rows, "p string", lambda: B.http_class(F.col("p"))) == [
        "HTTP_SQL_INJECTION", "HTTP_SQL_INJECTION", "HTTP_LFI", "HTTP_DIRECTORY_TRAVERSAL", "HTTP_COMMAND_INJECTION", None, None]


def test_dns_class(spark):
    rows = [("a" * 51,), ("a" * 50,), ("my-C2.org",), ("a123456.org",), ("a12345.org",), (None,)]
    assert values(spark, rows, "q string", lambda: B.dns_class(F.col("q"))) == ["DNS_TUNNELING", None, "DNS_EXFILTRATION", "DNS_EXFILTRATION", None, None]


def test_shellcode_reads_bytes(spark):
    rows = [(b"x" + b"\x90" * 8,), (b"\x90" * 7,), (b"\x09" + b"\x09" * 8 + b"\x00",), (b"a\x0f\x1f\x40\x00",), (bytes(range(256)),), (b"",), (None,)]
    assert values(spark, rows, "p binary", lambda: B.is_shellcode(F.col("p"), B.byte_entropy("p"))) == [True, False, False, True, True, False, False]


def test_entropy(spark):
    assert values(spark, [("aabb",), ("a",), ("",), (None,)], "p string", lambda: B.text_entropy(F.col("p"))) == [1.0, 0.0, 0.0, 0.0]
    # characters outside the basic plane count as one
    assert values(spark, [("\U0001F600\U0001F601",)], "p string", lambda: B.text_entropy(F.col("p"))) == [1.0]
    assert values(spark, [(b"aabb",), (b"",), (None,)], "p binary", lambda: B.byte_entropy("p")) == [1.0, 0.0, 0.0]


def test_tcp_anomaly_order(spark):
    rows = [(19, 0), (6, 0), (2, 0), (2, 1), (16, 0), (23, 5)]
    got = values(spark, rows, "f int, w int", lambda: P.tcp_anomaly(F.col("f"), F.col("w"), F.lit(True)))
    assert [g and g.split(": ")[1] for g in got] == ["SYN-ACK-FIN flags set", "SYN-RST flags set", "Zero window without ACK", None, None, "SYN-ACK-FIN flags set"]


def test_connection_flags(spark):
    rows = [(18,), (2,), (17,), (4,), (1,), (16,)]
    assert values(spark, rows, "f int", lambda: P.connection_flag_rules(F.col("f"), F.lit(True))) == ["SF", "S0", "SF", "RSTO", "SF", "OTH"]
    assert values(spark, rows, "f int", lambda: P.connection_flag_exact(F.col("f"), F.lit(True))) == ["S1", "S0", "S2", "RSTR", "SF", "OTH"]


def test_port_selection(spark):
    rows = [(None, "70000"), ("12", "13"), ("x", "13"), (None, None), ("-4", None)]
    assert values(spark, rows, "a string, b string", lambda: P.select_port(F.col("a"), F.col("b"))) == [65535, 12, 0, 0, 0]


def test_gates(spark):
    gate = lambda: V.prediction_gate(F.col("l"), F.col("c"), F.col("s"), F.col("d"), F.lit(6))
    rows = [("3", 0.9, 1, 443), ("3", 0.69, 1, 2), ("3", 0.7, 1, 2), ("28", 0.94, 1, 2), ("28", 0.95, 1, 2), ("Postgres", 0.9, 1, 2)]
    assert values(spark, rows, "l string, c double, s int, d int", gate) == [
        "benign_common_port", "benign_low_confidence", "3", "benign_low_confidence", "28", "benign_low_confidence_db"]
    last = lambda: V.alert_gate(F.col("l"), F.col("c"), F.col("s"), F.col("d"))
    rows = [("3", 0.84, 1, 2), ("3", 0.85, 1, 2), ("28", 0.99, 1, 2), ("28", 0.97, 1, 5432), ("28", 0.98, 1, 3400), ("benign", 1.0, 1, 2), ("3", 1.0, 1, 80)]
    assert values(spark, rows, "l string, c double, s int, d int", last) == ["below_threshold", "alert", "benign", "below_threshold", "alert", "benign", "benign"]


def test_names_and_severity(spark):
    assert values(spark, [("13",), ("99",), ("scan",)], "l string", lambda: V.flow_class_name(F.col("l"))) == ["PortScan", "Unknown_Attack_99", "scan"]
    assert values(spark, [(0,), (None,), (9,), (-1,), (2,)], "s int", lambda: V.severity_bucket(F.col("s"))) == [3, 3, 4, 1, 2]
    assert values(spark, [("DoS", 5), ("x", 2), ("x", 3), ("sql dos", 5)], "g string, s int", lambda: V.alert_category(F.col("g"), F.lit(None).cast("string"), F.col("s"))) == [
        "DoS Attempt", "Suspicious Activity", None, "SQL Injection"]
    assert values(spark, [(0.86,), (0.84,), (0.9,)], "c double", lambda: V.confidence_band(F.col("c"))) == ["medium", "medium", "high"]
    assert values(spark, [(5001.0,), (1001.0,), (1000.0,)], "p double", lambda: V.load_band(F.col("p"))) == ["very_high", "high", "normal"]


@pytest.mark.parametrize("columns,expected", [(["a", "Class", "label"], "Class"), (["a", "my_label"], "my_label"), (["a", "b"], None)])
def test_label_column(columns, expected):
    assert cleaning.find_label_column(columns) == expected
    assert cleaning.find_label_column(columns, first_as_fallback=True) == (expected or "a")


def test_networks(spark):
    table = spark.createDataFrame([("10.1.2.3",), ("10.2.0.0",), ("::1",), ("bad",), (None,)], "ip string")
    assert [r["inside"] for r in lookups.in_networks(table, {"inside": "ip"}, ["10.1.0.0/16", "::1/128"]).collect()] == [True, False, True, False, False]


def test_constant_columns(spark):
    table = spark.createDataFrame([(1, 1, None), (1, 2, None), (None, 2, None)], "a int, b int, c int")
    assert cleaning.constant_columns(table) == ["a"]


def test_typed_load_nulls_what_does_not_fit(spark):
    table = spark.createDataFrame([("127", 1.0), ("128", 3e9), ("x", float("nan")), ("-128", -5.0), (None, None)], "protocol string, src_port double")
    assert [tuple(r) for r in cleaning.typed_load(table).collect()] == [(127, 1), (None, None), (None, None), (-128, -5), (None, None)]
    assert cleaning.typed_load(table).dtypes == [("protocol", "tinyint"), ("src_port", "int")]
