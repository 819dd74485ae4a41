"""Exact sampling: counts, reproducibility, copies of rows, and resampled classes."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import balance, neighbours, quantiles, sampling


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, "big" if i % 10 < 7 else "mid" if i % 10 < 9 else "small") for i in range(2000)]
    return spark.createDataFrame(rows, "id long, label string")


def test_split_is_exact_disjoint_and_reproducible(table):
    first = {r["id"]: r["is_test"] for r in sampling.train_test(table, "label", row_id=["id"]).collect()}
    again = {r["id"]: r["is_test"] for r in sampling.train_test(table.repartition(7), "label", row_id=["id"]).collect()}
    assert first == again and len(first) == 2000
    labels = dict(table.select("id", "label").collect())
    assert Counter(labels[i] for i, t in first.items() if t) == {"big": 280, "mid": 80, "small": 40}


def test_copies_of_a_row_are_counted_not_lost(spark):
    rows = spark.createDataFrame([("same", 1)] * 900 + [("same", 2)] * 60 + [("other", i) for i in range(50)], "label string, v int")
    kept = sampling.cap_classes(rows, "label", 100)
    assert dict(kept.groupBy("label").count().collect()) == {"same": 100, "other": 50}
    split = sampling.train_test(rows, "label")
    assert split.count() == 1010
    assert {(r["label"], r["is_test"]): r["count"] for r in split.groupBy("label", "is_test").count().collect()} == {
        ("same", True): 192, ("same", False): 768, ("other", True): 10, ("other", False): 40}


def test_samples(table):
    assert dict(sampling.sample_per_class(table, "label", n_samples=900, row_id=["id"]).groupBy("label").count().collect()) == {"big": 300, "mid": 300, "small": 200}
    assert sampling.sample_rows(table, n_samples=123, row_id=["id"]).distinct().count() == 123
    with pytest.raises(ValueError):
        sampling.sample_rows(table)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.normal(0, 1, (150, 4)), rng.normal(6, 1, (40, 4)), rng.normal(-6, 1, (10, 4))])
    labels = [0] * 150 + [1] * 40 + [2] * 10
    rows = [(i, labels[i], [float(x) for x in v]) for i, v in enumerate(vectors)]
    return vectors, labels, spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_pruned_neighbours_are_exact(points, metric):
    vectors, _, table = points
    got = {}
    for r in neighbours.nearest(table, table, 5, metric=metric, exclude_self=True, pivots=9, block_rows=20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["neighbour_id"]
    diff = vectors[:, None, :] - vectors[None, :, :]
    d = np.abs(diff).sum(2) if metric == "manhattan" else np.sqrt((diff ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for i in range(len(vectors)):
        assert [got[i][k] for k in range(1, 6)] == list(np.argsort(d[i], kind="stable")[:5])


def test_smote_fills_classes_with_points_between_their_parents(points):
    vectors, labels, table = points
    made = balance.smote(table).collect()
    assert Counter(r["label"] for r in made) == {1: 110, 2: 140}
    for r in made:
        a, b, x = vectors[r["vec_id"]], vectors[r["partner"]], np.array(r["embedding"])
        assert labels[r["vec_id"]] == labels[r["partner"]] == r["label"] and r["vec_id"] != r["partner"]
        assert np.all(x >= np.minimum(a, b) - 1e-9) and np.all(x <= np.maximum(a, b) + 1e-9)


def test_smote_without_neighbours_adds_nothing(spark):
    table = spark.createDataFrame([(1, 0, [0.0]), (2, 0, [1.0]), (3, 1, [5.0])], "vec_id long, label int, embedding array<double>")
    assert balance.smote(table).count() == 0


@pytest.mark.parametrize("exact_rows", [50, 10_000])
@pytest.mark.parametrize("p", [0.5, 0.6])
def test_exact_percentiles(spark, exact_rows, p):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=3001), rng.integers(0, 3, 3001).astype(float)
    table = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y)], "x double, y double, z double")
    got = quantiles.exact_percentiles(table, ["x", "y", "z"], p, exact_rows)
    assert got["x"] == pytest.approx(np.quantile(x, p), abs=1e-12) and got["y"] == np.quantile(y, p) and got["z"] is None


def test_duplicate_minorities(table):
    out = balance.duplicate_minorities(table.withColumn("x", F.lit(1)), "label")
    assert dict(out.groupBy("label").count().collect()) == {"big": 1400, "mid": 800, "small": 400}
