"""Greedy rules and scan state against small state machines."""

import random

import pytest

from packetloom.operators.greedy import flow_reset, rate_limit
from packetloom.operators.scans import horizontal_scans, scan_state


def packets(n=500, seed=5, hot=0.5):
    rng = random.Random(seed)
    t, out = 0.0, []
    for i in range(n):
        t += rng.choice([0.25, 0.5, 1.0, 3.0, 25.0, 59.75, 60.0, 61.0]) if rng.random() < 0.3 else 0.25
        src = "10.0.0.1" if rng.random() < hot else f"10.0.0.{rng.randint(2, 5)}"
        out.append((i, t, src, f"10.0.1.{rng.randint(1, 8)}", 6, 1000, rng.randint(1, 12), 60, 2))
    return out


SCHEMA = "pkt_id long, ts_s double, src_ip string, dst_ip string, proto int, sport int, dport int, length int, tcp_flags int"


@pytest.mark.parametrize("slice_rows", [None, 40])
def test_flow_reset(spark, slice_rows):
    rows = packets()
    got = {r["pkt_id"]: (r["flow_packet_count"], r["flow_duration"]) for r in flow_reset(spark.createDataFrame(rows, SCHEMA), ["src_ip"], 60.0, slice_rows).collect()}
    state, resets = {}, 0
    for i, t, src, *_ in rows:
        times = state.setdefault(src, [])
        times.append(t)
        assert got[i] == (len(times), times[-1] - times[0])
        if times[-1] - times[0] > 60:
            state[src] = []
            resets += 1
    assert resets > 3 and len(got) == len(rows)


@pytest.mark.parametrize("slice_rows", [None, 40])
def test_rate_limit(spark, slice_rows):
    rows = packets(seed=6)
    got = {r["pkt_id"]: r["admitted"] for r in rate_limit(spark.createDataFrame(rows, SCHEMA), ["proto", "src_ip"], "ts_s", "pkt_id", 4, 20.0, slice_rows).collect()}
    state = {}
    for i, t, src, *_ in rows:
        recent = state[src] = [x for x in state.get(src, []) if t - x < 20]
        assert got[i] == (len(recent) < 4)
        if len(recent) < 4:
            recent.append(t)
    assert True in got.values() and False in got.values()


@pytest.mark.parametrize("chunk", ["1000000", "31"])
def test_scan_state(spark, chunk):
    rows = packets(seed=7)
    spark.conf.set("packetloom.rowsPerChunk", chunk)
    got = {r["pkt_id"]: (r["n_ports"], r["n_targets"]) for r in scan_state(spark.createDataFrame(rows, SCHEMA)).collect()}
    spark.conf.unset("packetloom.rowsPerChunk")
    state = {}
    for i, t, src, dst, _, _, dport, *_ in rows:
        ports, targets, last = state.get(src, (set(), set(), -1e9))
        if t - last > 60:
            ports, targets = set(), set()
        ports.add(dport)
        targets.add(dst)
        state[src] = (ports, targets, t)
        assert got[i] == (len(ports), len(targets))


@pytest.mark.parametrize("chunk", ["1000000", "31"])
def test_window_scan(spark, chunk):
    rows = packets(seed=8)
    spark.conf.set("packetloom.rowsPerChunk", chunk)
    got = {r["pkt_id"]: r["n_distinct"] for r in horizontal_scans(spark.createDataFrame(rows, SCHEMA), threshold=3).collect()}
    spark.conf.unset("packetloom.rowsPerChunk")
    want = {}
    for i, t, src, dst, _, _, dport, *_ in rows:
        held = [r for r in rows if r[2] == src and r[3] == dst and t - 60 <= r[1] <= t and r[0] <= i]
        is_new = not any(r[6] == dport for r in held if r[0] < i)
        n = len({r[6] for r in held})
        if is_new and n >= 3:
            want[i] = n
    assert got == want and want
