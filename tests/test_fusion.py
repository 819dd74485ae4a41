"""Tiered alert match against the plain definition, including its time bounds."""

import random

import pytest

from packetloom.operators.fusion import match_alerts, parse_events, read_alerts


def brute(packets, alerts, window=30.0):
    out = {}
    for i, t, s, d in packets:
        best = None
        for n, at, a, b in alerts:
            if not t - window <= at <= t:
                continue
            tier = 1 if (a, b) == (s, d) else 2 if (a, b) == (d, s) else 3 if {a, b} & {s, d} else None
            if tier and (best is None or (-tier, at, n) > best):
                best = (-tier, at, n)
        if best:
            out[i] = (-best[0], best[2])
    return out


@pytest.mark.parametrize("chunk", ["1000000", "29"])
def test_match(spark, chunk):
    rng = random.Random(11)
    ip = lambda: "10.0.0.1" if rng.random() < 0.3 else f"10.0.0.{rng.randint(2, 9)}"
    packets = [(i, i * 1.5, ip(), ip()) for i in range(200)]
    alerts = [(n, float(rng.randint(0, 300)), ip(), ip()) for n in range(25)] + [(90, 0.0, "10.0.0.77", "10.0.0.78")]
    packets.append((900, 30.0, "10.0.0.77", "10.0.0.78"))  # exactly at the bound: matches
    packets.append((901, 30.25, "10.0.0.78", "10.0.0.77"))  # past it: does not
    spark.conf.set("packetloom.rowsPerChunk", chunk)
    got = {r["pkt_id"]: (r["tier"], r["event_no"]) for r in match_alerts(
        spark.createDataFrame(packets, "pkt_id long, ts_s double, src_ip string, dst_ip string"),
        spark.createDataFrame(alerts, "event_no long, ts_s double, src_ip string, dest_ip string")).collect()}
    spark.conf.unset("packetloom.rowsPerChunk")
    assert got == brute(packets, alerts)
    assert got[900] == (1, 90) and 901 not in got
    assert {t for t, _ in got.values()} == {1, 2, 3}


def test_alert_aliases_and_flow_promotion(spark):
    lines = [
        (0, 0.0, '{"event_type":"alert","src":"1.1.1.1","dest":"2.2.2.2","sig":"old","sid":7,"alert":{"severity":0}}'),
        (1, 1.0, '{"event_type":"flow","src_ip":"a","dest_ip":"b","flow":{"alerted":true}}'),
        (2, 2.0, '{"event_type":"flow","src_ip":"a","dest_ip":"b"}'),
        (3, 3.0, "{broken"), (4, 4.0, '{"event_type":"dns"}'),
    ]
    table = spark.createDataFrame(lines, "event_no long, ts_s double, line string")
    assert parse_events(table).count() == 4
    got = {r["event_no"]: (r["src_ip"], r["signature"], r["severity"], r["signature_id"]) for r in read_alerts(table).collect()}
    assert got == {0: ("1.1.1.1", "old", 3, 7), 1: ("a", "Flow Event a->b", 3, 999999)}
    assert {r["event_no"]: r["severity"] for r in read_alerts(table, promote_all=True).collect()} == {0: 3, 1: 3, 2: 5}
