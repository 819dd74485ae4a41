"""Label and category encoding, scaling, feature selection. Fit once, apply as one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.cleaning import numeric_columns
from packetloom.operators.lookups import small_side

MAX_CATEGORIES = 10_000


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """Distinct labels with codes 0..k-1 in ascending order."""
    distinct = df.select(F.col(label).alias("label")).where(F.col("label").isNotNull()).distinct()
    return distinct.withColumn("code", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))


def encode_label(df: DataFrame, label: str, codes: DataFrame | None = None) -> DataFrame:
    """Replace the label by its code; unknown labels become null."""
    codes = label_codes(df, label) if codes is None else codes
    return df.join(small_side(codes.select(F.col("label").alias("_label"), "code")), F.col(label) == F.col("_label"), "left").withColumn(
        label, F.col("code")).drop("_label", "code")


def categories(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Distinct values per column. They become column names, so their number is bounded; wider
    vocabularies go through ``one_hot_vectors``."""
    found = {}
    for c in columns:
        rows = df.select(F.col(c).cast("string").alias("v")).where("v is not null").distinct().limit(MAX_CATEGORIES + 1).collect()
        if len(rows) > MAX_CATEGORIES:
            raise ValueError(f"{c} has more than {MAX_CATEGORIES} values")
        found[c] = sorted(r.v for r in rows)
    return found


def one_hot_vectors(df: DataFrame, columns: list[str], suffix: str = "_vector") -> DataFrame:
    """Add a sparse 0/1 vector per column, for vocabularies too wide for one column per value.

    Values are indexed by falling frequency; null and unseen values share the last place.
    """
    indexer = StringIndexer(inputCols=columns, outputCols=[f"_{c}_index" for c in columns], handleInvalid="keep")
    encoder = OneHotEncoder(inputCols=indexer.getOutputCols(), outputCols=[c + suffix for c in columns], dropLast=False)
    return Pipeline(stages=[indexer, encoder]).fit(df).transform(df).drop(*indexer.getOutputCols())


def one_hot_all(df: DataFrame, label: str = "label", values: dict[str, list[str]] | None = None) -> DataFrame:
    """Every string column but the label as 0/1 columns ``column_value``."""
    columns = [c for c, t in df.dtypes if t == "string" and c != label]
    values = values or categories(df, columns)
    plain = [c for c in df.columns if c not in columns]
    hot = [F.when(F.col(c) == v, 1).otherwise(0).alias(f"{c}_{v}") for c in columns for v in values[c]]
    return df.select(*plain, *hot)


def column_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population variance per column, long form."""
    stats = df.agg(*[F.var_pop(c).alias(c) for c in columns])
    return stats.unpivot([], columns, "column_name", "variance")


@dataclass(frozen=True)
class MinMax:
    """Fitted column ranges."""

    ranges: dict[str, tuple[float | None, float | None]]

    @staticmethod
    def fit(df: DataFrame, columns: list[str]) -> "MinMax":
        row = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).first()
        return MinMax({c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns})

    def scaled(self, c: str) -> Column:
        """(x - min) / (max - min); a constant column becomes 0."""
        lo, hi = self.ranges[c]
        if lo is None or lo == hi:
            return F.when(F.col(c).isNotNull(), 0.0).alias(c)
        return ((F.col(c) - F.lit(float(lo))) / F.lit(float(hi) - float(lo))).alias(c)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.scaled(c) if c in self.ranges else F.col(c) for c in df.columns])


def fit_selection(df: DataFrame, columns: list[str], threshold: float | None) -> tuple[list[str], MinMax]:
    """Columns whose population variance exceeds the threshold (all if None) and their ranges,
    from one pass over the table."""
    row = df.agg(*[F.var_pop(c).alias(f"v_{c}") for c in columns], *[F.min(c).alias(f"lo_{c}") for c in columns],
                 *[F.max(c).alias(f"hi_{c}") for c in columns]).first()
    kept = [c for c in columns if threshold is None or (row[f"v_{c}"] is not None and row[f"v_{c}"] > threshold)]
    return kept, MinMax({c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in kept})


def minmax_scale(df: DataFrame, label: str = "label") -> DataFrame:
    return MinMax.fit(df, [c for c in numeric_columns(df) if c != label]).apply(df)


def class_weights(classes: DataFrame) -> DataFrame:
    """Weight n / (k * count) per class from the per-class counts."""
    everything = Window.partitionBy()  # one row per class
    total, k = F.sum("n").over(everything), F.count(F.lit(1)).over(everything)
    return classes.select("label", "n", (total / (k * F.col("n"))).alias("weight"))


def with_weights(df: DataFrame, label: str, weights: DataFrame) -> DataFrame:
    """Rows with their class weight."""
    return df.join(small_side(weights.select(F.col("label").alias("_label"), "weight")), F.col(label) == F.col("_label")).drop("_label")
