"""Batch preparation jobs: every statistic is fitted on the whole table, then applied as one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators import cleaning, encoding, sampling
from packetloom.operators.lookups import small_side


@dataclass(frozen=True)
class Prepared:
    """What was fitted: original and kept columns, and the ranges used for scaling."""

    original: list[str]
    selected: list[str]
    scaler: encoding.MinMax
    codes: DataFrame

    def names(self) -> dict:
        return {"original_features": self.original, "processed_features": [f"feature_{i}" for i in range(len(self.selected))]}


def preprocess_flow_table(
    df: DataFrame, label: str | None = None, select_features: bool = False, threshold: float = 0.1,
    balance: bool = False, max_samples: int = 50_000, typed: bool = False,
) -> tuple[DataFrame, Prepared]:
    """Types, median imputation, label codes, numeric coercion, selection, scaling, balancing."""
    label = label or cleaning.find_label_column(df.columns)
    if label is None:
        raise ValueError("no label column")
    features = [c for c in df.columns if c != label]
    stripped = df.withColumn(label, F.trim(F.col(label).cast("string")))
    table = cleaning.typed_load(stripped) if typed else stripped
    numeric = cleaning.coerce_numeric(cleaning.median_impute(table), features)

    kept, scaler = encoding.fit_selection(numeric, features, threshold if select_features else None)
    codes = small_side(encoding.label_codes(stripped, label))
    encoded = encoding.encode_label(scaler.apply(numeric.select(*kept, label)), label, codes)
    out = encoded.select(*[F.col(c).alias(f"feature_{i}") for i, c in enumerate(kept)], F.col(label).alias("label"))
    if balance:
        out = sampling.cap_classes(out, "label", max_samples)
    return out, Prepared(features, kept, scaler, codes)


def preprocess_connection_table(df: DataFrame, rare_threshold: int = 1000) -> DataFrame:
    """Drop columns, collapse rare services, one-hot, scale the numeric columns, encode the label."""
    table = cleaning.drop_constant(cleaning.drop_columns(df))
    table = cleaning.collapse_rare(table, "service", rare_threshold)
    numeric = [c for c in cleaning.numeric_columns(table) if c != "label"]
    hot = encoding.one_hot_all(table)
    return encoding.encode_label(encoding.MinMax.fit(table, numeric).apply(hot), "label")
