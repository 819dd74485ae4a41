"""Boosted class trees: exact rules are learnt, settings bite, splits equal those of plain sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators.boosting import Boosted, Settings, fit_boosted


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        a, b, c = float(rng.integers(0, 9)), float(rng.normal()), None if i % 10 == 0 else float(rng.normal())
        rows.append((i, a, b, c, int(a // 3) if a < 6 else 2 + int(b > 0)))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int").repartition(3)


def test_rules_are_learnt_and_saved(table):
    model = fit_boosted(table, ["a", "b", "c"], "label", 4, Settings(rounds=15, depth=3))
    scored = model.transform(table)
    assert scored.where("abs(b) > 0.2 and prediction <> label").count() == 0
    again = Boosted.from_json(model.to_json()).transform(table)
    assert again.select("id", "prediction").exceptAll(scored.select("id", "prediction")).count() == 0
    p = scored.select(F.col("probability").alias("p")).first().p
    assert len(p) == 4 and sum(p) == pytest.approx(1)


def test_first_split_equals_plain_sums(table):
    model = fit_boosted(table, ["a", "b"], "label", 4, Settings(rounds=1, depth=1, patience=1))
    frame = table.withColumn("h", F.xxhash64(F.lit(42), "label", "a", "b")).toPandas()
    used = frame[frame["h"].to_numpy() % 5 != 0]
    codes, share = model.codes(used), np.exp(model.start)
    for k, tree in enumerate(model.trees[0]):
        g, h = share[k] - (used["label"].to_numpy() == k), share[k] * (1 - share[k])
        best = max(((cut, j) for j in range(2) for cut in range(33)), key=lambda x: sum(
            g[m].sum() ** 2 / (h * m.sum() + 1) if min(m.sum(), (~m).sum()) * h >= 1 else -np.inf
            for m in (codes[:, x[1]] <= x[0], codes[:, x[1]] > x[0])))
        m = codes[:, tree["feature"][0]] <= tree["code"][0]
        assert np.array_equal(m, codes[:, best[1]] <= best[0])
        assert tree["value"][1] == pytest.approx(-0.3 * g[m].sum() / (h * m.sum() + 1))


def test_noise_stops_early_and_settings_bite(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x), float(y), int(k)) for x, y, k in zip(rng.normal(size=800), rng.normal(size=800), rng.integers(0, 3, 800))]
    noise = spark.createDataFrame(rows, "x double, y double, label int")
    stopped = fit_boosted(noise, ["x", "y"], "label", 3, Settings(rounds=40, patience=2))
    assert len(stopped.trees) < 12
    for harsh in (Settings(rounds=2, gamma=1e6), Settings(rounds=2, min_child_weight=1e6)):
        assert all(max(t["feature"]) < 0 for turn in fit_boosted(noise, ["x", "y"], "label", 3, harsh).trees for t in turn)
    narrow = fit_boosted(noise, ["x", "y"], "label", 3, Settings(rounds=1, depth=2, patience=9, feature_share=0.5, row_share=0.5))
    assert all(len({f for f in t["feature"] if f >= 0}) <= 1 for turn in narrow.trees for t in turn)


def test_a_second_batch_adds_trees(spark, table, tmp_path):
    from packetloom.plans.training import grow_boosted, train_model
    from packetloom.sources import sinks

    first, second = table.where("label < 2"), table
    model = fit_boosted(first, ["a", "b", "c"], "label", 4, Settings(rounds=3, depth=2))
    grown = grow_boosted(model, second, Settings(rounds=6, depth=3))
    assert grown.trees[:len(model.trees)] == model.trees and len(grown.trees) > len(model.trees)
    wrong = lambda m: m.transform(table).where("prediction <> label").count()
    assert wrong(grown) < wrong(model) / 2
    with pytest.raises(ValueError):
        fit_boosted(table, ["a"], "label", 4, None, model)
    trained = train_model("gradient_boosting", table, table, ["a", "b"], ["id"], maxIter=8, maxDepth=3, stepSize=0.3)
    assert isinstance(trained.model, Boosted) and trained.metrics["accuracy"] > 0.95
    sinks.save_model(trained.model, str(tmp_path / "m"), {"x": 1})
    loaded, metadata = sinks.load_model(str(tmp_path / "m"))
    assert loaded == trained.model and metadata["x"] == 1
