"""The two-sided alert match on streams against the batch match, with alerts that arrive late."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators.fusion import match_alerts
from packetloom.streaming.matching import best_events, match_stream
from packetloom.streaming.jobs import batch_table, run_batches
from packetloom.streaming.replay import replay

PACKETS = "pkt_id long, ts_s double, src_ip string, dst_ip string, sport int, dport int, proto int, length int, arrives double"
ALERTS = "event_no long, ts_s double, src_ip string, dest_ip string, signature string, severity int, arrives double"
DAY = 86_400.0


def feeds(delay):
    rng = random.Random(3)
    ip = lambda: f"10.0.0.{rng.randint(1, 4)}"
    packets = [(i, i * 2.5, ip(), ip(), None if i % 9 == 0 else 1024, 443, 6, 60, i * 2.5) for i in range(120)]
    alerts = []
    for n in range(14):
        t = float(rng.randint(0, 300)) + rng.choice([0.0, 0.0004])
        alerts.append((n, t, ip(), ip() if n % 3 else "10.0.0.99", f"s{n}", None if n == 5 else n % 5, t + delay))
    return packets, alerts


@pytest.mark.parametrize("slices, delay, spread", [(1, 0.0, 1), (3, 45.0, 3)])
def test_late_alerts_find_their_packets(spark, slices, delay, spread):
    packets, alerts = feeds(delay)
    p, a = spark.createDataFrame(packets, PACKETS), spark.createDataFrame(alerts, ALERTS)
    best = {r.pkt_id: r.event_no for r in match_alerts(p, a).collect()}
    want = {i: alerts[best[i]][4] if i in best else None for i in range(len(packets))}
    landed = p.withColumn("is_packet", F.lit(True)).withColumnRenamed("dst_ip", "dest_ip").unionByName(
        a.withColumn("is_packet", F.lit(False)), allowMissingColumns=True)

    def run(stream, path, checkpoint):
        feed = stream()
        found = match_stream(feed.where("is_packet").withColumnRenamed("dest_ip", "dst_ip"), feed.where("not is_packet"), spread=spread, origin=DAY)
        run_batches(found, checkpoint, lambda df, i: batch_table(best_events(df), path, i))

    rows = replay(landed, run, slices=slices, close=True, origin=DAY, by="arrives").collect()
    assert len(rows) == len(packets) and {r.pkt_id: r.signature for r in rows} == want
    assert {r.pkt_id for r in rows if r.is_alert} == set(best) and best
    assert all(r.src_port is None for r in rows if r.pkt_id % 9 == 0)


def test_a_frame_is_one_value_of_the_store():
    """Every row was appended to a list of its own key, each append reading all before it."""
    import pandas as pd

    from packetloom.streaming.matching import PACKET, AlertMatch

    calls = []

    class Map(dict):
        def updateValue(self, key, value):
            calls.append("put")
            self[key] = value

        def getValue(self, key):
            calls.append("get")
            return self[key]

        def removeKey(self, key):
            calls.append("remove")
            del self[key]

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Handle:
        timers = []

        def getMapState(self, name, key, value):
            return Map()

        def getListState(self, name, row):
            raise AssertionError("a list is appended to row by row")

        def getValueState(self, name, value):
            return Value()

        def registerTimer(self, at):
            self.timers.append(at)

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    match, key = AlertMatch(30.0), ("10.0.0.1|10.0.0.2", True, 0.0, 0)
    match.init(Handle())
    rows = [(True, int(i * 100), i / 10, i, i % 2 == 0, None, None, "10.0.0.1", "10.0.0.2", None if i % 9 == 0 else 1024, 443, 6, 60) for i in range(4000)]
    rows += [(False, int(n * 50_000), n * 50.0, n, n % 3 == 0, f"s{n}", n or None, None, None, None, None, None, None) for n in range(9)]
    columns = ["is_packet", "at", "ts_s", "row_no", "up", "signature", "severity", *PACKET]
    frame = pd.DataFrame(rows, columns=columns)
    list(match.handleInputRows(key, iter([frame[i::4] for i in range(4)]), None))
    assert len(calls) <= 8
    out = pd.concat([*match.handleExpiredTimer(key, Now(200_000), None), *match.handleExpiredTimer(key, Now(10 ** 7), None)]).set_index("pkt_id").sort_index()
    assert len(out) == 4000 and out.index.is_unique and len(calls) < 60
    assert not match.waiting.keys() and not match.alerts.keys()
    for i in range(4000):
        n = i // 500
        near = i / 10 - n * 50.0 <= 30.0
        got = out.loc[i]
        assert (got["event_no"] == n and got["signature"] == f"s{n}") if near else pd.isna(got["event_no"])
        assert not near or (got["tier"] == (1 if (n % 3 == 0) == (i % 2 == 0) else 2) and (pd.isna(got["severity"]) if n == 0 else got["severity"] == n))
        assert pd.isna(got["sport"]) if i % 9 == 0 else got["sport"] == 1024
