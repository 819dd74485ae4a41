"""Files in and out: encodings, mixed folders, labels from names, captures."""

import socket
import struct

import pytest

from packetloom.sources import pcap, sinks, tables


def test_csv_encoding_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(" Flow Duration,Label\n1,café\n".encode("latin1"))
    (tmp_path / "b.csv").write_text("Label, Tot Byts\nx,5\n")
    assert tables.csv_encoding(spark, str(tmp_path / "a.csv")) == "ISO-8859-1"
    assert tables.csv_encoding(spark, str(tmp_path / "b.csv")) == "UTF-8"
    rows = {r["label"]: (r["flow_duration"], r["tot_byts"]) for r in tables.read_directory(spark, str(tmp_path)).collect()}
    assert rows == {"café": ("1", None), "x": (None, "5")}
    with pytest.raises(ValueError):
        tables.read_directory(spark, str(tmp_path / "none"))


def test_headerless(spark, tmp_path):
    (tmp_path / "names.csv").write_text("duration,continuous\nservice,symbolic\n")
    (tmp_path / "data.csv").write_text("1,http,normal,20\n")
    names = tables.field_names(spark, str(tmp_path / "names.csv"))
    assert names == ["duration", "service", "label", "difficulty"]
    row = tables.read_named(spark, str(tmp_path / "data.csv"), names, {"duration": "int"}).first()
    assert row.asDict() == {"duration": 1, "service": "http", "label": "normal", "difficulty": "20"}


def test_labels_from_file_names(spark, tmp_path):
    for name in ("neptune_1.csv", "udp_flood_2.csv", "syn_ack_flood_3.csv"):
        (tmp_path / name).write_text("a\n1\n")
    assert sorted(r["label"] for r in tables.label_by_file(spark, str(tmp_path)).collect()) == ["neptune", "syn", "udp"]
    assert [r["label"] for r in tables.label_by_prefix(spark, str(tmp_path), ["neptune", "back"]).collect()] == ["neptune"]


def frame(proto, body, src="10.0.0.1", dst="10.0.0.2", ttl=64):
    ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, ttl, proto, 0, socket.inet_aton(src), socket.inet_aton(dst))
    return b"\0" * 12 + b"\x08\x00" + ip + body


def capture(frames, order="<", cut=0):
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 100 + i, 250_000, len(f), len(f)) + f
    return out[:len(out) - cut]


@pytest.mark.parametrize("order", ["<", ">"])
def test_pcap(spark, tmp_path, order):
    tcp = struct.pack("!HHIIBBHHH", 1234, 80, 7, 9, 5 << 4, 0x12, 512, 0, 0) + b"GET /"
    udp = struct.pack("!HHHH", 53, 5353, 8 + 3, 0) + b"abc"
    icmp = bytes([8, 1, 0, 0, 0, 0, 0, 0])
    arp = b"\0" * 12 + b"\x08\x06" + b"x" * 28
    (tmp_path / "smurf_1.pcap").write_bytes(capture([frame(6, tcp), frame(17, udp), frame(1, icmp), arp, frame(6, tcp)], order, cut=3))
    (tmp_path / "note.txt").write_text("no capture")
    rows = sorted(pcap.read_pcaps(spark, str(tmp_path)).collect(), key=lambda r: r["pkt_id"])
    assert [(r["proto"], r["sport"], r["dport"], r["ip_version"]) for r in rows] == [(6, 1234, 80, 4), (17, 53, 5353, 4), (1, 0, 0, 4), (None, 0, 0, 0)]
    assert (rows[0]["tcp_flags"], rows[0]["tcp_window"], bytes(rows[0]["payload"]), rows[0]["ttl"]) == (18, 512, b"GET /", 64)
    assert (rows[1]["udp_len"], bytes(rows[1]["payload"])) == (11, b"abc")
    assert (rows[2]["icmp_type"], rows[2]["icmp_code"]) == (8, 1)
    assert rows[0]["ts_s"] == pytest.approx(100.25)
    labelled = pcap.labelled_pcaps(spark, str(tmp_path))
    assert labelled.count() == 3 and labelled.select("label").distinct().first()[0] == "smurf"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, label string")
    path = str(tmp_path / "csv")
    sinks.append_csv(df, path)
    sinks.append_csv(df, path)
    assert tables.read_csv(spark, path).count() == 4
    sinks.overwrite(df, path, "csv")
    assert tables.read_csv(spark, path).count() == 2
    sinks.write_json(spark, {"a": [1, 2]}, str(tmp_path / "meta"))
    assert sinks.read_json(spark, str(tmp_path / "meta")) == {"a": [1, 2]}
    sinks.write_labelled(df, str(tmp_path / "by_label"))
    assert sorted(p.name for p in (tmp_path / "by_label").glob("label=*")) == ["label=a", "label=b"]


def test_capture_job(spark, tmp_path):
    from packetloom import vocab
    from packetloom.plans import captures, training

    tcp = struct.pack("!HHIIBBHHH", 1234, 80, 7, 9, 5 << 4, 0x02, 512, 0, 0) + b"GET /"
    udp = struct.pack("!HHHH", 53, 5353, 8 + 3, 0) + b"abc"
    (tmp_path / "neptune_1.pcap").write_bytes(capture([frame(6, tcp)] * 5))
    (tmp_path / "smurf_1.pcap").write_bytes(capture([frame(17, udp)] * 4))
    records = captures.capture_features(spark, str(tmp_path))
    assert {(r["label"], r["n"]) for r in records.groupBy("label").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == {("neptune", 5), ("smurf", 4)}
    captures.extract_captures(spark, str(tmp_path), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("label=*")) == ["label=neptune", "label=smurf"]
    coded = records.selectExpr("*", "CASE label WHEN 'neptune' THEN 9 ELSE 18 END AS code").drop("label").withColumnRenamed("code", "label")
    model = training.train_model("decision_tree", coded, coded, vocab.KDD_MODEL_COLUMNS, ["pkt_id"], maxDepth=3).model
    found = captures.score_captures(spark, str(tmp_path), model)
    assert {(r["file"], r["prediction"]) for r in found.collect()} == {("neptune_1.pcap", "neptune"), ("smurf_1.pcap", "smurf")}
