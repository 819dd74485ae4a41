"""Ordered scans against plain Python, with one key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators.timeline import cut_points, running, session_cells, trailing

ROWS = None


def make_rows(n=600, seed=3):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), float(rng.randint(0, 900)) / 4, rng.randint(1, 9), rng.choice([None, rng.randint(0, 99)])) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, t double, v long, o int").repartition(5)


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_values(spark, table, rows, small_chunks, keys):
    cuts = cut_points(table, "t")
    assert not cuts.single
    got = {r["id"]: r for r in running(table, keys, ["t", "id"], cuts, sums={"s": F.col("v")}, mins={"lo": F.col("v")}, maxs={"hi": F.col("v")},
                                       lasts={"seen": F.col("o")}, prevs={"before": F.col("o")}).collect()}
    assert len(got) == len(rows)
    state = {}
    for i, k, t, v, o in sorted(rows, key=lambda r: (r[2], r[0])):
        s = state.setdefault(k if keys else "", {"s": 0, "lo": 99, "hi": 0, "seen": None, "before": None})
        s["s"] += v
        s["lo"], s["hi"] = min(s["lo"], v), max(s["hi"], v)
        s["seen"] = s["seen"] if o is None else o
        assert [got[i][c] for c in ("s", "lo", "hi", "seen", "before")] == [s["s"], s["lo"], s["hi"], s["seen"], s["before"]]
        s["before"] = o


@pytest.mark.parametrize("chunked", [False, True])
def test_trailing_sum_has_inclusive_bounds(spark, rows, chunked):
    distinct = {r[2]: r for r in rows}  # distinct times: peers of a time are counted in id order
    table = spark.createDataFrame(list(distinct.values()), "id long, k string, t double, v long, o int")
    if chunked:
        spark.conf.set("packetloom.rowsPerChunk", "37")
    got = {r["id"]: r["n"] for r in trailing(table, ["k"], "t", "id", 10.0, {"n": F.col("v")}).collect()}
    spark.conf.unset("packetloom.rowsPerChunk")
    for i, k, t, _, _ in distinct.values():
        assert got[i] == sum(r[3] for r in distinct.values() if r[1] == k and t - 10 <= r[2] <= t)


@pytest.mark.parametrize("inclusive,expected", [(False, {0.0: [0.0, 60.0, 120.0], 180.25: [180.25]}), (True, {0.0: [0.0], 60.0: [60.0], 120.0: [120.0], 180.25: [180.25]})])
def test_session_gap_boundary(spark, inclusive, expected):
    table = spark.createDataFrame([("x", t) for t in (0.0, 60.0, 120.0, 180.25)], "k string, t double")
    cells = session_cells(table, ["k"], "t", 60.0, inclusive=inclusive).collect()
    found = {}
    for c in sorted(cells, key=lambda c: c["_first"]):
        found.setdefault(c["_session"], []).append(c["_first"])
    assert found == expected
