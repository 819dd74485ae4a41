"""Nearest neighbours: the estimates leave the exact result, and most pairs uncomputed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import balance, neighbours


def brute(q, q_ids, reach, rows, ids, k, metric, exclude_self):
    with np.errstate(all="ignore"):
        d = neighbours._distances(q, rows, metric)
    if exclude_self:
        d[q_ids[:, None] == ids[None, :]] = np.inf
    out = []
    for i in range(len(q)):
        near = sorted((x, n) for x, n in zip(d[i].tolist(), ids.tolist()) if np.isfinite(x) and x <= reach[i])[:k]
        out += [(i, n, x) for x, n in near]
    return out


def cases():
    rng = np.random.default_rng(7)
    plain = rng.normal(size=(900, 12))
    far = plain + 1e9  # differences small beside the values
    copies = plain.copy()
    copies[100:700] = copies[100]
    copies[700:760] = copies[5]
    grid = rng.integers(0, 3, size=(900, 4)).astype(float)  # many equal distances
    odd = plain.copy()
    odd[3, 2], odd[4, 0], odd[7] = np.nan, np.inf, 1e200
    tiny = plain * 1e-200
    mixed = plain * 10.0 ** rng.integers(-40, 30, size=(900, 1))
    return {"plain": plain, "far": far, "copies": copies, "grid": grid, "odd": odd, "tiny": tiny, "mixed": mixed}


@pytest.mark.parametrize("name", sorted(cases()))
@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_estimates_lose_no_neighbour(monkeypatch, name, metric):
    monkeypatch.setattr(neighbours, "SLICE_ROWS", 128)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 64)
    monkeypatch.setattr(neighbours, "PAIR_ROWS", 999)
    rows, ids = cases()[name], np.arange(900, dtype=np.int64) * 7 % 900
    ids[800:] = ids[:100]  # keys may repeat
    reach = np.where(np.arange(200) % 3 == 0, 3.0, np.inf)
    for exclude_self in (False, True):
        args = (rows[:200], ids[:200], reach, rows, ids, 5, metric, exclude_self)
        with np.errstate(all="ignore"):
            got = neighbours._k_nearest(*args)
        assert list(zip(*(x.tolist() for x in got))) == brute(*args)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_few_pairs_are_computed_in_full(monkeypatch, metric):
    """One pair in a hundred at most; all of them were."""
    computed = []
    whole = neighbours._pair_distances
    monkeypatch.setattr(neighbours, "_pair_distances", lambda a, b, m: computed.append(len(a)) or whole(a, b, m))
    monkeypatch.setattr(neighbours, "_distances", None)
    rows = np.random.default_rng(1).normal(size=(20_000, 64))
    rows[:3000] = rows[0]
    ids = np.arange(20_000)
    neighbours._k_nearest(rows[2500:3500], ids[2500:3500], np.full(1000, np.inf), rows, ids, 5, metric, True)
    assert sum(computed) < 1000 * 20_000 / 100


@pytest.mark.parametrize("metric, within", [("euclidean", None), ("manhattan", None), ("euclidean", "label")])
def test_cells_and_parts_lose_no_neighbour(spark, metric, within):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 6))
    vectors[50:120] = vectors[50]
    rows = [(i, vectors[i].tolist(), int(i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = neighbours.nearest(df, df, 4, metric=metric, within=within, exclude_self=True, block_rows=40, pivots=5)
    found = {(r.query_id, r["rank"]): (r.neighbour_id, r.distance) for r in got.collect()}
    d = neighbours._distances(vectors, vectors, metric)
    for i in range(400):
        others = [j for j in range(400) if j != i and (within is None or j % 3 == i % 3)]
        for rank, j in enumerate(sorted(others, key=lambda j: (d[i, j], j))[:4], 1):
            assert found[i, rank] == (j, d[i, j])
    assert len(found) == 1600


def test_adasyn_searches_once(spark, monkeypatch):
    """The shares are read twice; the search behind them ran for each reading."""
    kept = []
    monkeypatch.setattr(balance, "materialise", lambda df, name: kept.append(name) or df)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist(), int(i % 5 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    made = balance.adasyn(df)
    assert kept == ["share"] and made.where(F.col("label") == 1).count() > 0
