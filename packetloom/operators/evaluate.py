"""Classifier evaluation from (actual, predicted[, score]) rows.

Everything derives from the confusion counts, so the rows are read once and aggregated map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.lookups import small_side
from packetloom.operators.timeline import Cuts, cut_points, running


def confusion_counts(predictions: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return predictions.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Long form, with the share of the actual class."""
    per_class = Window.partitionBy("actual")
    return confusion_counts(predictions, actual, predicted).withColumn("share", F.col("n") / F.sum("n").over(per_class))


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(bottom > 0, top / F.greatest(bottom, F.lit(1))).otherwise(F.lit(0.0))


def class_scores(predictions: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of every class seen in either column."""
    sides = confusion_counts(predictions, actual, predicted).select(F.explode(F.array(
        F.struct(F.col("actual").alias("class"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"),
                 F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("hit"),
                 F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed")),
    )).alias("s")).select("s.*")
    sums = sides.groupBy("class").agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("claimed").alias("claimed"))
    rated = sums.select("class", "hit", "support", _ratio(F.col("hit"), F.col("claimed")).alias("precision"),
                        _ratio(F.col("hit"), F.col("support")).alias("recall"))
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2.0 * F.col("precision") * F.col("recall") / F.when(both > 0, both).otherwise(1.0)).otherwise(F.lit(0.0))
    return rated.withColumn("f1", f1)


def macro_metrics(predictions: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Accuracy and macro-averaged precision, recall and F1."""
    return class_scores(predictions, actual, predicted).agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), F.avg("f1").alias("f1_score"))


def classification_report(predictions: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Per-class rows plus ``macro avg`` and ``weighted avg``."""
    scores = class_scores(predictions, actual, predicted)
    per_class = scores.select(F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support")
    macro = scores.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                       F.sum("support").alias("support")).withColumn("class", F.lit("macro avg"))
    weighted_mean = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    weighted = scores.agg(weighted_mean("precision").alias("precision"), weighted_mean("recall").alias("recall"),
                          weighted_mean("f1").alias("f1"), F.sum("support").alias("support")).withColumn("class", F.lit("weighted avg"))
    return per_class.unionByName(macro).unionByName(weighted)


def score_cuts(predictions: DataFrame, score: str) -> Cuts:
    return cut_points(predictions.select((-F.col(score)).alias("rank")), "rank")


def score_curve(predictions: DataFrame, actual: str = "actual", score: str = "score", cuts: Cuts | None = None) -> DataFrame:
    """Cumulative true and false positives at every distinct score, highest first.

    Scores are counted before they are ordered, and the ordered scan is balanced, since a large
    table can hold about as many scores as rows.
    """
    steps = predictions.groupBy((-F.col(score)).alias("rank")).agg(
        F.count_if(F.col(actual) == 1).alias("pos"), F.count_if(F.col(actual) != 1).alias("neg"))
    cuts = cuts or score_cuts(predictions, score)
    summed = running(steps, [], ["rank"], cuts, sums={"tp": F.col("pos"), "fp": F.col("neg")})
    return summed.select((-F.col("rank")).alias("threshold"), "tp", "fp", "rank")


def roc_curve(predictions: DataFrame, actual: str = "actual", score: str = "score", cuts: Cuts | None = None) -> DataFrame:
    """Rates at every threshold, with the area up to it by the trapezoid rule."""
    cuts = cuts or score_cuts(predictions, score)
    curve = score_curve(predictions, actual, score, cuts)
    totals = predictions.agg(F.count_if(F.col(actual) == 1).alias("all_pos"), F.count_if(F.col(actual) != 1).alias("all_neg"))
    rated = curve.select("threshold", "rank", (F.col("fp") / totals.select("all_neg").scalar()).alias("fpr"),
                         (F.col("tp") / totals.select("all_pos").scalar()).alias("tpr"))
    paired = running(rated, [], ["rank"], cuts, prevs={"prev_fpr": F.col("fpr"), "prev_tpr": F.col("tpr")})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    area = (F.col("fpr") - zero(F.col("prev_fpr"))) * (F.col("tpr") + zero(F.col("prev_tpr"))) / 2.0
    return paired.select("threshold", "fpr", "tpr", area.alias("area"))


def roc_auc(predictions: DataFrame, actual: str = "actual", score: str = "score", cuts: Cuts | None = None) -> DataFrame:
    return roc_curve(predictions, actual, score, cuts).agg(F.sum("area").alias("auc"))


def pr_curve(predictions: DataFrame, actual: str = "actual", score: str = "score", cuts: Cuts | None = None) -> DataFrame:
    """Precision and recall at every threshold."""
    curve = score_curve(predictions, actual, score, cuts)
    total = predictions.agg(F.count_if(F.col(actual) == 1).alias("all_pos"))
    return curve.select("threshold", "rank", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                        (F.col("tp") / total.scalar()).alias("recall"))


def average_precision(predictions: DataFrame, actual: str = "actual", score: str = "score", cuts: Cuts | None = None) -> DataFrame:
    """Precision weighted by the recall gained at each threshold."""
    cuts = cuts or score_cuts(predictions, score)
    curve = pr_curve(predictions, actual, score, cuts)
    paired = running(curve, [], ["rank"], cuts, prevs={"prev_recall": F.col("recall")})
    gain = F.col("recall") - F.coalesce("prev_recall", F.lit(0.0))
    return paired.agg(F.sum(gain * F.col("precision")).alias("average_precision"))


def leaderboard(results: DataFrame) -> DataFrame:
    """Models by F1, best first."""
    return results.orderBy(F.desc("f1_score"), "model_name")


def metric_ranks(results: DataFrame, metrics: tuple[str, ...] = ("accuracy", "precision", "recall", "f1_score")) -> DataFrame:
    """Long form: every metric of every model and its rank among the models."""
    long = results.unpivot(["model_name"], list(metrics), "metric", "value")
    return long.withColumn("place", F.dense_rank().over(Window.partitionBy("metric").orderBy(F.desc("value"))))


def majority_fallback(predictions: DataFrame, classes: DataFrame, majority: Column, predicted: str = "predicted") -> DataFrame:
    """Predictions outside the trained classes become the majority class."""
    known = small_side(classes.select(F.col("class").alias("_class")).distinct())
    joined = predictions.join(known, F.col(predicted) == F.col("_class"), "left")
    return joined.withColumn(predicted, F.when(F.col("_class").isNotNull(), F.col(predicted)).otherwise(majority)).drop("_class")


def top_probabilities(predictions: DataFrame, probability: str = "probability", k: int = 5) -> DataFrame:
    """The k most likely classes of each prediction; the vector has one entry per class."""
    from pyspark.ml.functions import vector_to_array

    pairs = F.transform(vector_to_array(probability), lambda p, i: F.struct((-p).alias("neg"), i.alias("class")))
    ranked = F.slice(F.array_sort(pairs), 1, k)
    return predictions.select("*", F.posexplode(ranked).alias("rank", "entry")).select(
        *predictions.columns, (F.col("rank") + 1).alias("rank"), F.col("entry.class").alias("class"), (-F.col("entry.neg")).alias("p"))


def best_class(predictions: DataFrame, probability: str = "probability") -> DataFrame:
    """Most likely class (lowest id on ties) and its probability."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array(probability)
    return predictions.withColumns({
        "confidence": F.array_max(p), "predicted": (F.array_position(p, F.array_max(p)) - 1).cast("int")})
