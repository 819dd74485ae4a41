"""Training, tuning, evaluation and scoring jobs on Spark ML."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.verdicts import prediction_gate
from packetloom.operators import balance, cleaning, encoding, evaluate, lookups, neighbours, profiling, sampling
from packetloom.operators.boosting import Boosted, Settings, fit_boosted
from packetloom.operators.features import align_features
from packetloom.plans.preprocess import preprocess_flow_table
from packetloom.session import materialise
from packetloom.sources import sinks, tables

TUNING_ROWS = 100_000
# name -> (lowest, highest) of the random search, or a choice of texts; integers stay integers
SEARCH_SPACE: dict[str, dict[str, tuple]] = {
    "random_forest": {"numTrees": (50, 200), "maxDepth": (5, 30), "minInstancesPerNode": (1, 5)},
    "gradient_boosting": {"maxIter": (100, 300), "maxDepth": (3, 10), "stepSize": (0.01, 0.21)},
    "xgboost": {"maxIter": (100, 500), "maxDepth": (3, 15), "stepSize": (0.01, 0.31), "subsamplingRate": (0.6, 1.0)},
    "logistic_regression": {"C": (0.1, 10.1)},
    "decision_tree": {"maxDepth": (5, 30), "minInstancesPerNode": (1, 5)},
    "knn": {"k": (3, 20), "weights": ("uniform", "distance"), "metric": ("euclidean", "manhattan")},
}


class MacroF1(Evaluator):
    """Macro-averaged F1 of integer predictions; the built-in F1 weights classes by size."""

    def __init__(self, label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        row = evaluate.macro_metrics(dataset, self.label, self.prediction).first()
        return float(row["f1_score"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def estimator(name: str, classes: int, rows: int = 1, weight: str | None = None, validation: str | None = None, **params):
    """Unfitted estimator by name. Boosted trees are binary, so more classes go one-vs-rest."""
    weighted = {"weightCol": weight} if weight else {}
    if name == "random_forest":
        settings = {"numTrees": 10, "maxDepth": 6, "featureSubsetStrategy": "sqrt", "seed": 42, **weighted, **params}
        return RandomForestClassifier(featuresCol="features", labelCol="label", **settings)
    if name == "decision_tree":
        return DecisionTreeClassifier(featuresCol="features", labelCol="label", seed=42, **weighted, **{"maxDepth": 10, **params})
    if name == "logistic_regression":
        settings = dict(params)
        c = settings.pop("C", 1.0)
        return LogisticRegression(featuresCol="features", labelCol="label", family="multinomial",
                                  **{"maxIter": 100, "regParam": 1.0 / (c * max(rows, 1)), **weighted, **settings})
    if name in ("gradient_boosting", "xgboost"):
        settings = {"maxIter": 20, "maxDepth": 6 if name == "xgboost" else 3, "stepSize": 0.1, "seed": 42, **params}
        if classes <= 2:
            stop = {"validationIndicatorCol": validation} if validation else {}
            return GBTClassifier(featuresCol="features", labelCol="label", **weighted, **stop, **settings)
        return OneVsRest(classifier=GBTClassifier(featuresCol="features", labelCol="label", **weighted, **settings), labelCol="label", featuresCol="features", parallelism=2,
                         **({"weightCol": weight} if weight else {}))
    raise ValueError(f"unknown model {name}")


def draw_params(name: str, n: int, seed: int = 42) -> list[dict]:
    """Random draws from the search space of a model."""
    rng = random.Random(seed)

    def pick(bounds: tuple):
        if isinstance(bounds[0], str):
            return rng.choice(bounds)
        return rng.randint(*bounds) if isinstance(bounds[0], int) else rng.uniform(*bounds)

    return [{p: pick(bounds) for p, bounds in SEARCH_SPACE[name].items()} for _ in range(n)]


def random_search(name: str, train: DataFrame, classes: int, row_id: list[str], n_iter: int = 5, folds: int = 3, seed: int = 42,
                  parallelism: int = 2, space: list[dict] | None = None, tuning_rows: int = TUNING_ROWS, **fixed) -> tuple[dict, float]:
    """Best parameters by cross-validated macro F1.

    Parameters are tuned on at most ``tuning_rows`` labelled rows, a stratified sample of larger
    tables; the chosen model is fitted on all rows.
    """
    rows = train.count()
    if rows > tuning_rows:
        train = sampling.split_by_quota(train, "label", sampling.class_sizes(train, "label").select(
            "label", F.greatest(F.lit(1), F.round(F.col("n") * (tuning_rows / rows))).cast("bigint").alias("quota")), seed, row_id).where("chosen").drop("chosen")
    folded = train.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), *row_id), F.lit(folds)).cast("int"))
    model = estimator(name, classes, rows, **fixed)
    draws = space or draw_params(name, n_iter, seed)
    cv = CrossValidator(estimator=model, estimatorParamMaps=[_param_map(model, d, rows) for d in draws], evaluator=MacroF1(),
                        numFolds=folds, foldCol="_fold", parallelism=parallelism, seed=seed)
    scores = [float(v) for v in cv.fit(folded).avgMetrics]
    best = max(range(len(draws)), key=lambda i: scores[i])
    return draws[best], scores[best]


def _param_map(model, params: dict, rows: int) -> dict:
    """Parameters by name on the estimator, or on the one a one-vs-rest model wraps."""
    inner = model.getClassifier() if isinstance(model, OneVsRest) else model
    named = {("regParam" if k == "C" else k): (1.0 / (v * max(rows, 1)) if k == "C" else v) for k, v in params.items()}
    return {inner.getParam(k): v for k, v in named.items()}


BOOSTED = ("gradient_boosting", "xgboost")


def boosting_settings(name: str, params: dict) -> Settings:
    """Settings of class trees by the names the estimators have for them."""
    names = {"maxIter": "rounds", "maxDepth": "depth", "stepSize": "step", "subsamplingRate": "row_share"}
    given = {names.get(k, k): v for k, v in params.items()}
    return Settings(**{"rounds": 20, "depth": 6 if name == "xgboost" else 3, "step": 0.1, **given})


def grow_boosted(model: Boosted, batch: DataFrame, settings: Settings | None = None) -> Boosted:
    """A warm start: trees learnt from a new labelled batch are added, the earlier ones stay."""
    return fit_boosted(batch, model.features, "label", model.classes, settings, model)


@dataclass
class Trained:
    name: str
    model: PipelineModel | Boosted
    metrics: dict
    params: dict = field(default_factory=dict)
    features: list[str] = field(default_factory=list)


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature columns plus the vector the estimators read."""
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def resample(train: DataFrame, features: list[str], method: str | None, row_id: list[str]) -> DataFrame:
    """Balance the training rows: ``duplicate`` (batched form), ``smote`` or ``adasyn``."""
    if method is None:
        return train
    if method == "duplicate":
        return balance.duplicate_minorities(train, "label")
    vectors = train.select(F.xxhash64("label", *row_id).alias("_id"), "label", F.array(*[F.col(c).cast("double") for c in features]).alias("_v"))
    make = balance.smote if method == "smote" else balance.adasyn
    made = make(vectors, "label", "_v", "_id").select("label", *[F.col("_v")[i].alias(c) for i, c in enumerate(features)])
    return train.select("label", *[F.col(c).cast("double").alias(c) for c in features]).unionByName(made)


def train_model(name: str, train: DataFrame, test: DataFrame, features: list[str], row_id: list[str], sampling_method: str | None = None,
                tune: bool = False, n_iter: int = 5, folds: int = 3, weighted: bool = False, failures: list[dict] | None = None, **params) -> Trained | None:
    """Resample, tune, fit, evaluate. A failed fit is retried with a small model, then given up.

    The metrics name the parameters of the model that was fitted and the error of a first attempt;
    a model that was given up is appended to ``failures`` with its error.
    """
    began = time.time()
    counts = {r["label"]: r["n"] for r in sampling.class_sizes(train, "label").collect()}
    rows = sum(counts.values())
    method = sampling_method if name != "logistic_regression" else None
    fitted = resample(train, features, method, row_id)
    if method:
        fitted = materialise(fitted, "resampled")  # read by every pass of the fit
    weight = None
    if weighted or name == "logistic_regression":
        weights = encoding.class_weights(profiling.label_distribution(fitted, "label")).withColumn("label", F.col("label").cast("int"))
        fitted, weight = encoding.with_weights(fitted, "label", weights), "weight"
    vectors = assemble(fitted, features)
    if tune:
        best, _ = random_search(name, assemble(train, features), len(counts), row_id, n_iter, folds)
        params = {**params, **best}
    validation = None
    if name in BOOSTED and len(counts) <= 2:
        # early stopping watches a fifth of the training rows
        vectors = vectors.withColumn("_validation", F.pmod(F.xxhash64(*features), F.lit(5)) == 0)
        validation = "_validation"
    error = ""
    if name in BOOSTED and len(counts) > 2 and weight is None:
        boosted = fit_boosted(fitted, features, "label", max(counts) + 1, boosting_settings(name, params))
    else:
        boosted = None
    try:
        model = boosted or estimator(name, len(counts), rows, weight, validation, **params).fit(vectors)
    except Exception as e:  # the model, not the job, is given up
        error = f"{type(e).__name__}: {str(e)[:500]}"
        small = {"random_forest": {"numTrees": 5, "maxDepth": 5}, "decision_tree": {"maxDepth": 5}}.get(name, {"maxIter": 5})
        try:
            model = estimator(name, len(counts), rows, weight, validation, **small).fit(vectors)
            params = small
        except Exception:
            if failures is not None:
                failures.append({"model_name": name, "error": error})
            return None
    pipeline = boosted or PipelineModel([VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), model])
    majority = max(counts, key=lambda c: (counts[c], -c))
    predicted = pipeline.transform(test).withColumn("prediction", F.col("prediction").cast("int"))
    known = F.col("prediction").isin(list(counts))  # classes are a handful of codes
    scored = predicted.select("label", F.when(known, F.col("prediction")).otherwise(majority).alias("prediction"))
    metrics = evaluate.macro_metrics(scored, "label", "prediction").first().asDict()
    return Trained(name, pipeline, {"model_name": name, **metrics, "training_time": time.time() - began, "fitted_with": json.dumps(params, sort_keys=True), "error": error}, params, features)


def train_knn(train: DataFrame, test: DataFrame, features: list[str], row_id: str, k: int = 5, weights: str = "uniform", metric: str = "euclidean") -> dict:
    """Metrics of the neighbour classifier, which has no fitted state beyond its training rows."""
    vector = lambda df: df.select(row_id, "label", F.array(*[F.col(c).cast("double") for c in features]).alias("v"))
    found = neighbours.knn_classify(vector(test), vector(train), k, "label", "v", row_id, weights, metric)
    scored = test.select(row_id, "label").join(found, row_id)
    return {"model_name": "knn", **evaluate.macro_metrics(scored, "label", "predicted").first().asDict()}


def search_knn(train: DataFrame, features: list[str], row_id: str, n_iter: int = 5, folds: int = 3, seed: int = 42,
               space: list[dict] | None = None) -> tuple[dict, float]:
    """Best neighbour count, vote and metric by cross-validated macro F1."""
    folded = materialise(train.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), row_id), F.lit(folds))), "folds")
    best, best_score = {}, -1.0
    for params in space or draw_params("knn", n_iter, seed):
        scores = [train_knn(folded.where(F.col("_fold") != i), folded.where(F.col("_fold") == i), features, row_id, **params)["f1_score"] for i in range(folds)]
        if sum(scores) / folds > best_score:
            best, best_score = params, sum(scores) / folds
    return best, best_score


def train_all(names: list[str], train: DataFrame, test: DataFrame, features: list[str], row_id: list[str], path: str | None = None, **options) -> DataFrame:
    """Train every named model; models and metrics go to ``path``; returns the leaderboard.

    A model that could not be fitted stands there with its error and no score.
    """
    results, failures = [], []
    for name in names:
        trained = train_model(name, train, test, features, row_id, failures=failures, **options)
        if trained is None:
            continue
        if path:
            sinks.save_model(trained.model, f"{path}/{name}", {"metrics": trained.metrics, "parameters": trained.params, "feature_names": features})
            sinks.append_leaderboard(trained.metrics, f"{path}/leaderboard")
        results.append(trained.metrics)
    schema = "model_name string, accuracy double, precision double, recall double, f1_score double, training_time double, fitted_with string, error string"
    rows = [tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in results + failures]
    return evaluate.leaderboard(train.sparkSession.createDataFrame(rows, schema))


def feature_importance(model: PipelineModel | Model, features: list[str], top: int = 20) -> DataFrame:
    """Most important features of a tree model."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    rows = [(f, float(v)) for f, v in zip(features, last.featureImportances.toArray())]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def score(df: DataFrame, model: PipelineModel | Boosted, features: list[str], keep: list[str]) -> DataFrame:
    """Align the input, predict, and take the most likely class with its probability."""
    return evaluate.best_class(model.transform(align_features(df, features, keep)))


def gated(scored: DataFrame, sport: str, dport: str, proto: str) -> DataFrame:
    """Scored rows with the label left after the prediction gates."""
    return scored.withColumn("outcome", prediction_gate(F.col("predicted"), F.col("confidence"), F.col(sport), F.col(dport), F.col(proto)))


def retrain(history: DataFrame, features: list[str], row_id: list[str], name: str = "random_forest", **params) -> Trained | None:
    """Periodic refit on everything collected so far, in place of adding trees batch by batch."""
    parts = sampling.train_test(history, "label", row_id=row_id)
    return train_model(name, parts.where(~F.col("is_test")), parts.where("is_test"), features, row_id, **params)


def run_training(spark: SparkSession, folder: str, output: str, binary: bool = False, n_samples: int | None = None, balance_classes: bool = False,
                 max_samples: int = 50_000, models: tuple[str, ...] = ("random_forest",), select_features: bool = True,
                 load: Callable[[SparkSession, str], DataFrame] = tables.read_directory, **options) -> DataFrame:
    """Load, clean, label, sample, preprocess, split and train: one lazy chain, written once before fitting."""
    raw = load(spark, folder)
    label = cleaning.find_label_column(raw.columns)
    if label is None:
        raise ValueError("no label column")
    cleaned = cleaning.standardise_labels(cleaning.clean_flows(cleaning.numeric_text(raw, label), label), label, binary)
    if n_samples:
        cleaned = sampling.sample_per_class(cleaned, "label", n_samples=n_samples)
    prepared, fitted = preprocess_flow_table(cleaned, "label", select_features, balance=balance_classes, max_samples=max_samples)
    sinks.write_json(spark, fitted.names(), f"{output}/feature_names")
    features = fitted.names()["processed_features"]
    kept = lookups.keep_classes(prepared.where("label is not null"), "label", 2)
    table = materialise(sampling.train_test(kept, "label"), "prepared")
    return train_all(list(models), table.where(~F.col("is_test")), table.where("is_test"), features, features, output, **options)
