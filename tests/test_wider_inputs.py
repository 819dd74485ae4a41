"""Inputs beyond the fixtures: mixed encodings and types, IPv6, captured bytes, repeated rows, slices."""

import ipaddress
import math
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_sources import capture, frame

from packetloom.operators import balance, detect, encoding, features, lookups, neighbours
from packetloom.plans.training import resample
from packetloom.sources import pcap, tables
from packetloom.streaming.jobs import late_rows, run_available, run_batches, throughput_stream
from packetloom.streaming.replay import replay
from packetloom.streaming.sources import packet_stream
from packetloom.streaming.state import decision_stream, running_flow_stream


def test_each_file_has_its_own_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("City,N\nZürich,1\n".encode("latin1"))
    (tmp_path / "b.csv").write_bytes("City,N\nZürich,2\n".encode())
    (tmp_path / "c.csv").write_bytes(b"Other\nx\n")
    rows = sorted((r["n"] or "", r["city"]) for r in tables.read_directory(spark, str(tmp_path)).collect())
    assert rows == [("", None), ("1", "Zürich"), ("2", "Zürich")]


def test_no_value_is_lost_where_types_clash(spark, tmp_path):
    (tmp_path / "a.csv").write_text("label,n\nBENIGN,1\nDoS,2\n")
    spark.createDataFrame([(0, 3), (1, 4)], "label int, n int").write.parquet(str(tmp_path / "p.parquet"))
    got = tables.read_directory(spark, str(tmp_path))
    assert dict(got.dtypes) == {"label": "string", "n": "int"}
    assert sorted(r["label"] for r in got.collect()) == ["0", "1", "BENIGN", "DoS"]
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(2**40, 0.5)], "x long, y double")
    assert sorted(map(tuple, tables.union_all([a, b]).collect())) == [(1, 2.0), (2**40, 0.5)]


def test_addresses_and_networks_of_both_versions(spark):
    ips = ["10.1.2.3", "10.200.0.1", "::1", "0:0:0:0:0:0:0:1", "2001:DB8::5", "2001:db8:0:0:1::", "::ffff:1.2.3.4", "bad", None, "fe80::", "1:2:3:4:5:6:7:8"]
    nets = ["10.1.0.0/16", "10.0.0.0/8", "::1/128", "2001:db8::/32", "::ffff:0:0/96", "0.0.0.0/0", "fe80::/10", "1:2:3:4:5:6:7:8"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = {(r["ip"], r["network"]) for r in lookups.network_join(df, "ip", spark.createDataFrame([(n,) for n in nets], "network string")).collect()}
    want = set()
    for i in ips:
        try:
            a = ipaddress.ip_address(i)
        except ValueError:
            continue
        want |= {(i, n) for n in nets if a.version == ipaddress.ip_network(n).version and a in ipaddress.ip_network(n)}
    assert got == want
    inside = lookups.in_networks(df, {"x": "ip"}, ["2001:db8::/32", "::1/128"]).where("x").select("ip").collect()
    assert {r["ip"] for r in inside} == {"::1", "0:0:0:0:0:0:0:1", "2001:DB8::5", "2001:db8:0:0:1::"}


def test_ranges_that_are_no_blocks(spark):
    rng = np.random.default_rng(4)
    ranges = [(int(a), int(a) + int(rng.integers(0, 300)), f"n{k}") for k, a in enumerate(rng.integers(167772160, 167772160 + 2000, 40))] + [(0, 2**32 - 1, "all")]
    ips = [167772160 + int(x) for x in rng.integers(0, 2400, 200)]
    df = spark.createDataFrame([(str(ipaddress.ip_address(i)),) for i in set(ips)], "ip string")
    got = Counter((r["ip"], r["network"]) for r in lookups.network_join(df, "ip", spark.createDataFrame(ranges, "lo long, hi long, network string")).collect())
    assert got == Counter((str(ipaddress.ip_address(i)), n) for i in set(ips) for lo, hi, n in ranges if lo <= i <= hi)


def test_captured_bytes_reach_features_and_detectors(spark, tmp_path):
    sled = bytes([0x90] * 8 + [0xFF, 0xFE, 0x80, 0x41])
    tcp = struct.pack("!HHIIBBHHH", 1234, 80, 7, 9, 5 << 4, 0x12, 512, 0, 0) + sled
    udp = struct.pack("!HHHH", 53, 5353, 8 + 4, 0) + b"\xffab\n"
    icmp = bytes([8, 3, 0, 0, 0, 0, 0, 0])
    (tmp_path / "x.pcap").write_bytes(capture([frame(6, tcp), frame(17, udp), frame(1, icmp)]))
    packets = pcap.read_pcaps(spark, str(tmp_path)).withColumn("pkt_id", F.row_number().over(Window.orderBy("pkt_id")).cast("long"))
    packets = packets.cache()

    def entropy(data):
        p = [c / len(data) for c in Counter(data).values()]
        return -sum(x * math.log2(x) for x in p) if data else 0.0

    wide = {r["pkt_id"]: r for r in features.features_47(packets, reset=None).collect()}
    assert wide[1]["payload_entropy"] == pytest.approx(entropy(sled))
    assert (wide[2]["udp_len"], wide[3]["icmp_type"], wide[3]["icmp_code"]) == (12, 8, 3)
    head = {r["pkt_id"]: r for r in features.header_features(packets).collect()}
    assert head[1]["entropy"] == pytest.approx(entropy(sled)) and head[1]["printable_ratio"] == pytest.approx(1 / 12)
    assert (head[1]["tcp_seq"], head[1]["tcp_ack"], head[2]["udp_len"], head[2]["payload_length"]) == (7, 9, 12, 4)
    found = packets.select("pkt_id", detect.ROW_DETECTORS["shellcode"](packets).alias("d")).where("d is not null").collect()
    assert [(r["pkt_id"], r["d"]) for r in found] == [(1, "SHELLCODE_DETECTED")]
    packets.unpersist()


def next_generation(frames):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    for i, f in enumerate(frames):
        at = (100 + i) * 1_000_000 + 250_000
        out += block(6, struct.pack("<IIIII", 0, at >> 32, at & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def test_next_generation_captures_equal_classic_ones(spark, tmp_path):
    frames = [frame(17, struct.pack("!HHHH", 53, 5353, 11, 0) + b"abc"), frame(1, bytes([8, 1, 0, 0, 0, 0, 0, 0]))]
    (tmp_path / "a.pcap").write_bytes(capture(frames))
    (tmp_path / "b.pcapng").write_bytes(next_generation(frames))
    (tmp_path / "c.pcap").write_bytes(b"no capture at all")
    rows = [r.asDict() for r in pcap.read_pcaps(spark, str(tmp_path), "*.pcap*").orderBy("file", "pkt_id").collect()]
    assert len(rows) == 4
    assert [{**r, "file": ""} for r in rows[:2]] == [{**r, "file": ""} for r in rows[2:]]
    assert [r["path"].rsplit("/")[-1] for r in pcap.skipped_captures(spark, str(tmp_path)).collect()] == ["c.pcap"]


@pytest.mark.parametrize("method", ["smote", "adasyn"])
def test_oversampling_counts_repeated_rows_once(spark, method):
    rows = [(0, float(i % 5), 1.0) for i in range(60)] + [(1, float(i % 5), 1.5) for i in range(20)]
    made = resample(spark.createDataFrame(rows, "label int, a double, b double"), ["a", "b"], method, ["a", "b"])
    counts = {r["label"]: r["count"] for r in made.groupBy("label").count().collect()}
    assert counts[0] == 60 and (counts[1] == 60 if method == "smote" else abs(counts[1] - 60) <= 5)


def test_synthetic_rows_lie_between_a_point_and_one_of_its_nearest(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(i >= 60), [float(x) for x in rng.normal(size=3)]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    made = balance.smote(df, k=3).collect()
    assert len(made) == 40
    points = {i: np.array(v) for i, c, v in rows if c == 1}
    for r in made:
        near = sorted((np.linalg.norm(points[r["vec_id"]] - p), j) for j, p in points.items() if j != r["vec_id"])[:3]
        assert r["partner"] in {j for _, j in near}


def test_knn_votes_on_text_labels(spark):
    rows = [(i, "even" if i < 5 else "odd", [float(i), 0.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    test = spark.createDataFrame([(100, [0.2, 0.0]), (101, [8.8, 0.0])], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["predicted"] for r in neighbours.knn_classify(test, df, 3).collect()} == {100: "even", 101: "odd"}


FLOWS = "pkt_id long, ts_s double, src_ip string, dst_ip string, sport int, dport int, proto int, length int"
TIMES = [0.0, 10.0, 500.0, 1000.0, 1010.0, 1311.0]


def append(transform):
    return lambda stream, path, checkpoint: run_available(transform(stream()), path, checkpoint)


@pytest.mark.parametrize("slices", [1, 2, 4])
def test_a_pause_ends_a_flow_wherever_batches_end(spark, slices):
    table = spark.createDataFrame([(i, t, "a", "b", 1, 80, 6, 10) for i, t in enumerate(TIMES)], FLOWS)
    got = replay(table, append(lambda s: running_flow_stream(s, idle=300.0)), slices=slices, origin=86_400.0).orderBy("pkt_id").collect()
    assert [r["flow_packets"] for r in got] == [1, 2, 1, 1, 2, 1]
    assert [r["flow_duration"] for r in got] == [0, 10, 0, 0, 10, 0]
    kept = replay(table, append(lambda s: decision_stream(s, keep=300.0)), slices=slices, origin=86_400.0).orderBy("pkt_id").collect()
    assert [r["decision"] for r in kept] == ["common_port", "cached_benign", "common_port", "common_port", "cached_benign", "common_port"]


def test_a_continuous_run_can_be_stopped(spark, tmp_path):
    table = spark.createDataFrame([(1, 1.0, "a", "b", 1, 80, 6, 10)], FLOWS)
    table.write.parquet(str(tmp_path / "in"))
    seen = []
    query = run_batches(packet_stream(spark, str(tmp_path / "in"), table.schema), str(tmp_path / "ck"), lambda df, i: seen.append(df.count()), continuous=True)
    query.processAllAvailable()
    query.stop()
    assert sum(seen) == 1 and not query.isActive


def test_late_rows_are_counted(spark, tmp_path):
    folder, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = [(i, float(t), "a", "b", 1, 80, 6, 10) for i, t in enumerate([0, 10, 5_000, 90_000])]
    spark.createDataFrame(rows, FLOWS).coalesce(1).write.mode("append").parquet(folder)
    schema, no = spark.createDataFrame(rows, FLOWS).schema, F.lit(False)
    stream = lambda: throughput_stream(packet_stream(spark, folder, schema, origin=86_400.0), no, no)
    assert late_rows(run_available(stream(), out, ck)) == 0
    spark.createDataFrame([(9, 1.0, "a", "b", 1, 80, 6, 10)], FLOWS).coalesce(1).write.mode("append").parquet(folder)
    assert late_rows(run_available(stream(), out, ck)) == 1


def test_wide_vocabularies_become_vectors(spark):
    df = spark.createDataFrame([(i, f"v{i % 50}" if i % 7 else None) for i in range(200)], "id long, service string")
    rows = encoding.one_hot_vectors(df, ["service"]).collect()
    assert all(r["service_vector"].size == 51 and r["service_vector"].values.tolist() == [1.0] for r in rows)
    assert {int(r["service_vector"].indices[0]) for r in rows if r["service"] is None} == {50}
