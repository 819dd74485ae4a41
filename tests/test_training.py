"""Training, saving, scoring on a table whose label follows from its features."""

import pytest
from pyspark.sql import functions as F

from packetloom.operators import evaluate
from packetloom.plans import training
from packetloom.sources import sinks


@pytest.fixture(scope="module")
def table(spark):
    base = spark.range(900).select(F.col("id"), ((F.col("id") * 37) % 100 / 100.0).alias("a"), ((F.col("id") * 53) % 100 / 100.0).alias("b"))
    return base.withColumn("label", F.when(F.col("a") < 0.4, 0).when(F.col("a") < 0.8, 1).otherwise(2)).cache()


@pytest.mark.parametrize("name,options", [("random_forest", {"sampling_method": "smote"}), ("decision_tree", {"weighted": True}), ("gradient_boosting", {"maxIter": 3})])
def test_models_learn(table, name, options):
    test = F.col("id") % 5 == 0
    trained = training.train_model(name, table.where(~test), table.where(test), ["a", "b"], ["id"], **options)
    assert trained.metrics["f1_score"] > 0.8


def test_save_load_score(spark, table, tmp_path):
    board = training.train_all(["decision_tree"], table, table, ["a", "b"], ["id"], path=str(tmp_path))
    assert board.first()["accuracy"] > 0.9
    model, meta = sinks.load_model(str(tmp_path / "decision_tree"))
    assert meta["feature_names"] == ["a", "b"]
    scored = training.score(table.select("id", "b", "a"), model, ["a", "b"], ["id"])
    assert scored.join(table, "id").where("predicted = label").count() > 850
    assert training.feature_importance(model, ["a", "b"]).first()["feature"] == "a"
    assert spark.read.parquet(str(tmp_path / "leaderboard")).count() == 1
    top = evaluate.top_probabilities(scored.select("id", "probability"), k=2)
    assert top.count() == 1800


def test_failed_fit_is_skipped(table):
    assert training.train_model("random_forest", table.withColumn("label", F.lit(None).cast("int")), table, ["a"], ["id"]) is None


def test_random_search_prefers_the_better_model(table):
    space = [{"maxDepth": 1}, {"maxDepth": 4}]
    best, score = training.random_search("decision_tree", training.assemble(table, ["a", "b"]), 3, ["id"], folds=3, space=space)
    assert best == {"maxDepth": 4} and score > 0.9
    assert training.draw_params("random_forest", 2) == training.draw_params("random_forest", 2)


def test_knn_metrics(table):
    test = F.col("id") % 5 == 0
    assert training.train_knn(table.where(~test), table.where(test), ["a", "b"], "id")["accuracy"] > 0.8
    best, score = training.search_knn(table, ["a", "b"], "id", folds=2, space=[{"k": 3}, {"k": 5, "weights": "distance"}])
    assert best in ({"k": 3}, {"k": 5, "weights": "distance"}) and score > 0.8
    assert {type(v) for v in training.draw_params("knn", 1)[0].values()} == {int, str}


def test_end_to_end(spark, table, tmp_path):
    folder = str(tmp_path / "in")
    named = table.select(F.col("a").alias(" Flow Dur"), F.col("b").alias("Tot Byts"), F.concat(F.lit(" class"), F.col("label").cast("string")).alias("Label"))
    named.write.option("header", True).csv(folder + "/part.csv")
    board = training.run_training(spark, folder, str(tmp_path / "out"), models=("decision_tree",), select_features=False)
    assert board.first()["accuracy"] > 0.9
    assert sinks.read_json(spark, str(tmp_path / "out/feature_names"))["original_features"] == ["flow_dur", "tot_byts"]
