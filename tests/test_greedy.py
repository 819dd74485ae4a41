"""Flow restart and rate limit of large keys: transfers, rings and chunks against row by row walks."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packetloom.operators.greedy import Transfer, admit_step, flow_reset, rate_limit, reset_step

STEPS = [0.0, 0.1, 0.25, 1.0, 3.0, 19.9, 20.0, 25.0, 59.75, 60.0, 61.0, 300.0]
times = st.lists(st.sampled_from(STEPS), min_size=1, max_size=80).map(lambda x: np.cumsum(x) + 0.3)


def walk_reset(ts, limit=60.0):
    held, out = [], []
    for t in ts:
        held.append(t)
        out.append((held[0], len(held)))
        if t - held[0] > limit:
            held = []
    return out, (held[0], len(held)) if held else (None, 0)


def walk_admit(ts, most, window):
    recent, out = [], []
    for t in ts:
        recent = [x for x in recent if t - x < window]
        out.append(len(recent) < most)
        if out[-1]:
            recent.append(t)
    return out


@given(times, st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_transfers_of_chunks_compose(ts, size):
    # equal times belong to one chunk
    cuts = [0, *[i for i in range(size, len(ts), size) if ts[i] > ts[i - 1]], len(ts)]
    parts = [Transfer.of(ts[a:b], 60.0) for a, b in zip(cuts, cuts[1:])]
    whole = parts[0]
    state = np.array([np.nan]), np.array([0])
    for i, (a, part) in enumerate(zip(cuts[1:], parts)):
        whole = whole if i == 0 else whole.then(part, 60.0)
        state = part.apply(*state, 60.0)
        for origin, seen in (state, whole.apply(np.array([np.nan]), np.array([0]), 60.0)):
            want = walk_reset(ts[:a])[1]
            assert (None if np.isnan(origin[0]) else origin[0], seen[0]) == want
    # an open segment from before
    before = ts[0] - 17.5
    origin, seen = whole.apply(np.array([before]), np.array([4]), 60.0)
    _, (want, n) = walk_reset(np.concatenate([[before] * 4, ts]))
    assert (None if np.isnan(origin[0]) else origin[0], seen[0]) == (want, n)


def test_transfers_stay_small():
    ts = np.sort(np.random.default_rng(1).uniform(0, 6000, 50_000))
    assert len(Transfer.of(ts, 60.0).bound) <= np.searchsorted(ts, ts[0] + 60) + 2


@given(times, st.integers(1, 6), st.integers(0, 79))
@settings(max_examples=200, deadline=None)
def test_rings_admit_like_lists(ts, most, cut):
    step, state, got = admit_step(most, 20.0), np.empty(0), []
    for part in (ts[:cut], ts[cut:]):
        out, state = step(part, state)
        got += out["admitted"].tolist()
        assert len(state) <= most
    assert got == walk_admit(ts, most, 20.0)


def test_ring_of_an_endless_flood():
    ts = np.arange(2_000_000) * 0.01
    out, ring = admit_step(100, 60.0)(ts, np.empty(0))
    assert out["admitted"].sum() == 100 * -(-20_000 // 60) and len(ring) == 100


def hot_table(n, seed):
    """One key with most rows, some small ones, a null key, and equal times."""
    rng = np.random.default_rng(seed)
    ts = np.cumsum(rng.choice([0.0, 0.25, 0.5, 3.0, 59.75, 61.0], n, p=[0.1, 0.4, 0.3, 0.18, 0.01, 0.01]))
    names = rng.choice(["hot", "a", "b", None], n, p=[0.8, 0.1, 0.05, 0.05])
    return [(i, float(t), k) for i, (t, k) in enumerate(zip(ts, names))]


@pytest.mark.parametrize("slice_rows", [60, 700])
def test_flow_reset_over_many_chunks(spark, slice_rows):
    rows = hot_table(4000, 3)
    found = flow_reset(spark.createDataFrame(rows, "pkt_id long, ts_s double, src_ip string").repartition(5), ["src_ip"], 60.0, slice_rows)
    got = {r.pkt_id: (r.ts_s - r.flow_duration, r.flow_packet_count) for r in found.collect()}
    assert len(got) == len(rows)
    for key in {k for _, _, k in rows}:
        of = [(i, t) for i, t, k in rows if k == key]
        want, _ = walk_reset([t for _, t in of])
        for (i, _), (origin, n) in zip(of, want):
            assert got[i][1] == n and got[i][0] == pytest.approx(origin)


@pytest.mark.parametrize("slice_rows", [50, 1500])
def test_rate_limit_of_an_endless_period(spark, slice_rows):
    rows = [r for r in hot_table(3000, 4) if r[2] is not None]
    found = rate_limit(spark.createDataFrame(rows, "pkt_id long, ts_s double, src_ip string").repartition(5), ["src_ip"], "ts_s", "pkt_id", 7, 65.0, slice_rows)
    got = {r.pkt_id: r.admitted for r in found.collect()}
    for key in ("hot", "a", "b"):
        of = [(i, t) for i, t, k in rows if k == key]
        assert [got[i] for i, _ in of] == walk_admit([t for _, t in of], 7, 65.0)


def test_periods_of_a_key_are_walked_apart(spark):
    """Rows of one key with pauses between go to several tasks."""
    rows = [(1000 * p + i, 1000.0 * p + 0.01 * i, "hot") for p in range(30) for i in range(50)]
    found = rate_limit(spark.createDataFrame(rows, "pkt_id long, ts_s double, src_ip string"), ["src_ip"], "ts_s", "pkt_id", 5, 20.0)
    assert found.where("admitted").count() == 150
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [src_ip" in plan and "period" in plan.split("RepartitionByExpression [src_ip")[1].split("]")[0]


def test_reset_step_ties():
    out, state = reset_step(60.0)(np.array([0.0, 0.0, 60.0, 61.0, 61.0]), np.empty(0))
    assert out["flow_packet_count"].tolist() == [1, 2, 3, 4, 1] and state.tolist() == [61.0, 1.0]
