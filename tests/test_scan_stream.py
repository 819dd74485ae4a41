"""Scan state on a stream against a plain walk, whatever the micro-batches."""

import random

import pytest

from packetloom.streaming.jobs import run_available
from packetloom.streaming.replay import replay
from packetloom.streaming.state import ScanState, scan_state_stream

DAY = 86_400.0


def walk(rows, idle):
    state, out = {}, {}
    for i, t, src, dst, dport in rows:
        ports, targets, last = state.get(src, (set(), set(), t))
        if t - last > idle:
            ports, targets = set(), set()
        ports.add(dport)
        targets.add(dst)
        state[src] = (ports, targets, t)
        out[i] = (len(ports), len(targets))
    return out


@pytest.mark.parametrize("slices", [1, 3])
def test_counts_do_not_depend_on_micro_batches(spark, slices):
    rng, t, rows = random.Random(5), 0.0, []
    for i in range(600):
        t += rng.choice([0.1, 1.0, 5.0]) if rng.random() < 0.97 else 200.0
        rows.append((i, t, f"10.0.0.{rng.randint(1, 2)}", f"10.1.{rng.randint(0, 3)}.{rng.randint(0, 20)}", rng.randint(1, 30)))
    table = spark.createDataFrame(rows, "pkt_id long, ts_s double, src_ip string, dst_ip string, dport int")
    run = lambda stream, path, checkpoint: run_available(scan_state_stream(stream(), origin=DAY), path, checkpoint)
    got = {r.pkt_id: (r.n_ports, r.n_targets) for r in replay(table, run, slices=slices, origin=DAY).collect()}
    assert got == walk(rows, 60.0)


def test_values_of_the_store_stay_small():
    class Map(dict):
        def getValue(self, key):
            return self.get(key)

        def updateValue(self, key, value):
            self[key] = value

    state = ScanState(60.0, 0.0)
    state.met = {"dst_ip": Map()}
    import numpy as np
    values = np.array([f"10.{i >> 16}.{i >> 8 & 255}.{i & 255}" for i in range(100_000)])
    assert state._new("dst_ip", values[:60_000]).sum() == 60_000
    assert state._new("dst_ip", values[50_000:]).sum() == 40_000
    assert max(len(v[0]) for v in state.met["dst_ip"].values()) < 200


def test_sessions_within_a_batch_stay_out_of_the_store():
    """Every session of a micro-batch was written to the store and cleared again."""
    import pandas as pd

    calls = []

    class Map(dict):
        def getValue(self, key):
            calls.append("get")
            return self.get(key)

        def updateValue(self, key, value):
            calls.append("put")
            self[key] = value

        def clear(self):
            calls.append("clear")
            super().clear()

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Handle:
        def registerTimer(self, at):
            pass

    state = ScanState(60.0, 0.0)
    state.handle, state.total, state.met = Handle(), Value(), {"dport": Map(), "dst_ip": Map()}
    rng = random.Random(8)
    rows, t = [], 0.0
    for i in range(6000):
        t += 200.0 if i % 10 == 0 else 1.0
        rows.append((i, t, "10.0.0.1", f"10.1.0.{rng.randint(0, 9)}", rng.randint(1, 9)))
    got = {}
    for batch in (rows[:2995], rows[2995:2998], rows[2998:]):  # the second goes on with the first, the third too
        frame = pd.DataFrame(batch, columns=["pkt_id", "ts_s", "src_ip", "dst_ip", "dport"]).drop(columns="src_ip")
        for out in state.handleInputRows(("10.0.0.1",), iter([frame]), None):
            got.update({r.pkt_id: (r.n_ports, r.n_targets) for r in out.itertuples()})
    assert got == walk(rows, 60.0)
    assert len(calls) < 200
