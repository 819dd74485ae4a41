"""Near-duplicate vectors against all cosines."""

import numpy as np
import pytest

from packetloom.llm import cross_polytope
from packetloom.llm.cross_polytope import Bucket, Index, forest, hadamard, key_length, near_vectors, tables_needed, unit

SCHEMA = "vec_id long, embedding array<float>, n_links int, h1 string"


def plain(rows, threshold=0.9):
    """(links, pairs) of rows (vec_id, vector) by comparing all with all."""
    fit = [(i, x) for i, (_, x) in enumerate(rows) if rows[i][0] is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    links = set()
    for size in {len(x) for _, x in fit}:
        at = [i for i, x in fit if len(x) == size]
        near = unit(np.array([rows[i][1] for i in at], np.float32))
        near = near @ near.T >= threshold
        links |= {(at[i], at[j]) for i, j in zip(*np.nonzero(near)) if i != j}
    return links


def components_of(rows, links):
    label = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for i, j in links:
            a, b = label[rows[i][0]], label[rows[j][0]]
            if a != b:
                label[rows[i][0]] = label[rows[j][0]] = min(a, b)
                changed = True
    return label


def planted(rng, n, dim, groups):
    """Random vectors, and groups of vectors around common centres."""
    x = [rng.normal(size=dim) for _ in range(n)]
    for size, noise in groups:
        centre = rng.normal(size=dim)
        x += [centre + noise * rng.normal(size=dim) for _ in range(size)]
    return [v.astype(np.float32).tolist() for v in x]


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 0, "") for i, x in rows], SCHEMA).repartition(3)


def check(spark, rows, recall=1.0):
    found = near_vectors(frame(spark, rows)).collect()
    links = plain(rows)
    want = [sum(1 for a, _ in links if a == i) for i in range(len(rows))]
    assert len(found) == len(rows)
    got = {r.vec_id: r for r in found}
    total = sum(r.n_links for r in found)
    assert recall * sum(want) <= total <= sum(want)
    for (vec_id, _), n in zip(rows, want):
        assert got[vec_id].n_links <= n
    if recall == 1.0:
        label = components_of(rows, links)
        for r in found:
            assert r.component_id == label[r.vec_id] and r.kept == (r.component_id == r.vec_id)
    return found


def test_hadamard_is_orthogonal():
    h = hadamard(np.eye(64, dtype=np.float32))
    assert np.allclose(h @ h.T, np.eye(64), atol=1e-5) and np.allclose(np.abs(h), 1 / 8)


@pytest.mark.parametrize("dim, n", [(64, 50_000), (64, 500), (100, 2000), (7, 300)])
def test_pairs_at_the_threshold_meet(dim, n):
    k = key_length(n, dim)
    tables, rng = tables_needed(dim, k, 0.9), np.random.default_rng(99)  # other pairs than those it was made with
    a, b = rng.normal(size=(2, 3000, dim))
    a = unit(a)
    b = unit(b - (a * b).sum(1)[:, None] * a)
    index = Index(dim, k, tables)
    x, y = (index.keys(v, range(tables)) for v in (a, 0.9 * a + np.sqrt(0.19) * b))
    assert (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3)).mean() > 0.94


def test_keys_do_not_depend_on_the_company():
    x = unit(np.random.default_rng(3).normal(size=(300, 48)))
    index = Index(48, 3, 6)
    assert np.array_equal(index.keys(x, range(6))[17:18, 4:], index.keys(x[17:18], range(4, 6)))


def test_forest_joins_paths():
    assert forest(7, np.array([5, 5, 1]), np.array([1, 2, 6])).tolist() == [0, 1, 1, 3, 4, 1, 1]


def test_groups_are_counted_whole(spark):
    rng = np.random.default_rng(1)
    vectors = planted(rng, 300, 64, [(150, 0.05), (40, 0.15), (30, 0.3), (5, 0.33)])
    vectors += [vectors[0]] * 60 + [vectors[310]] * 20  # copies
    vectors += [[3.0 * v for v in vectors[1]], [-v for v in vectors[2]]]
    ids = rng.permutation(len(vectors)).tolist()
    check(spark, list(zip(ids, vectors)), recall=0.95)
    tight = planted(rng, 200, 32, [(120, 0.02), (3, 0.02)])
    check(spark, list(zip(rng.permutation(len(tight)).tolist(), tight)))


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "BLOCK", 16)
    monkeypatch.setattr(cross_polytope, "TABLES_AT_ONCE", 1)
    vectors = planted(np.random.default_rng(2), 50, 64, [(200, 0.02), (60, 0.02)])
    check(spark, list(enumerate(vectors)))


def test_large_groups_by_strips():
    x = unit(np.random.default_rng(4).normal(size=(1, 16)) + 0.02 * np.random.default_rng(5).normal(size=(700, 16)))
    every = Bucket(np.zeros(700, int), np.zeros(700, int), np.zeros(700, int), np.ones(700, bool), x)
    halves = Bucket(np.zeros(700, int), np.zeros(700, int), np.arange(700) % 2, np.zeros(700, bool), x)
    assert len(every.pairs(0.9)[0]) == 700 * 699 // 2 and len(halves.pairs(0.9)[0]) == 350 * 350


def test_odd_vectors(spark):
    one = [float(i % 5 - 1) for i in range(24)]
    rows = [(1, one), (2, [2.5 * v for v in one]), (3, None), (4, []), (5, [0.0] * 24), (6, [None, *one[1:]]), (7, [float("nan"), *one[1:]]),
            (8, [float("inf"), *one[1:]]), (9, one[:20]), (10, one[:20]), (11, [1e30 * v for v in one]), (12, [1e-30 * v for v in one]),
            (13, [-0.0 if v == 0 else v for v in one]), (14, [1.0]), (15, [2.0]), (16, [-1.0]), (None, one), (None, None)]
    found = {r.vec_id: r for r in near_vectors(frame(spark, rows)).collect() if r.vec_id is not None}
    links, label = plain(rows), components_of(rows, plain(rows))
    for i, (vec_id, _) in enumerate(rows[:-2]):
        r = found[vec_id]
        assert (r.n_links, r.component_id) == (sum(a == i for a, _ in links), label[vec_id]), vec_id
    assert found[1].n_links == 4 and found[5].kept and not found[13].kept
    nameless = [r for r in near_vectors(frame(spark, rows)).collect() if r.vec_id is None]
    assert [(r.n_links, r.component_id, r.kept) for r in nameless] == [(0, None, False)] * 2


def test_repeated_ids_doubles_and_empty_table(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(7, a), (7, b), (3, a), (9, b), (9, b)]
    found = sorted(map(tuple, near_vectors(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()))
    assert found == [(3, 1, 3, True), (7, 1, 3, False), (7, 2, 3, False), (9, 2, 3, False), (9, 2, 3, False)]
    none = near_vectors(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]


def test_recall_on_the_given_table(spark, sf_dir):
    """Every 50th vector of the given table, with neighbours planted at 0.9 and a little above."""
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    rng, rows = np.random.default_rng(8), list(given)
    for vec_id, x in given:
        if vec_id % 50 == 0:
            x = unit(np.array([x]))[0]
            for j, cosine in enumerate((0.9001, 0.91, 0.93, 0.96)):
                y = rng.normal(size=len(x))
                y = unit((y - (x @ y) * x)[None])[0]
                rows.append((10_000 + 4 * vec_id + j, (cosine * x + np.sqrt(1 - cosine ** 2) * y).tolist()))
    check(spark, rows, recall=0.9)
