"""Label distribution, class statistics, recommended caps and structural profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.cleaning import numeric_columns


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows per label; missing labels are not counted."""
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def distribution_with_shares(classes: DataFrame) -> DataFrame:
    """Percentage (half-even, two digits) and cumulative percentage, largest class first.

    ``classes`` is the per-class table, so the unpartitioned windows see one row per class.
    """
    everything = Window.partitionBy()
    ranked = Window.orderBy(F.desc("n"), "label")
    upto = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pct = F.bround(F.col("n") / F.sum("n").over(everything) * 100, 2)
    return classes.withColumn("pct", pct).withColumn("cum_pct", F.sum("pct").over(upto))


def class_stats(classes: DataFrame) -> DataFrame:
    """Number of classes, total, min, max, median, mean and imbalance ratio."""
    return classes.agg(
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("total"), F.min("n").alias("min_n"), F.max("n").alias("max_n"),
        F.percentile("n", 0.5).alias("median_n"), F.avg("n").alias("mean_n"), (F.max("n") / F.min("n")).alias("imbalance"))


def suggested_cap(classes: DataFrame) -> DataFrame:
    """Recommended per-class cap and the high-imbalance warning."""
    stats = classes.agg(
        F.count(F.lit(1)).alias("classes"), F.percentile("n", 0.5).alias("median_n"), F.percentile("n", 0.6).alias("q60"),
        (F.max("n") / F.min("n")).alias("imbalance"))
    median, whole = F.col("median_n"), lambda c: F.floor(c)
    many = F.least(whole(median * 1.5), whole(F.col("q60")))
    few = F.least(F.lit(50000), whole(median))
    base = F.when(F.col("classes") > 10, many).otherwise(few)
    careful = F.when(F.col("imbalance") > 100, F.least(base, whole(median * 1.2))).otherwise(base)
    return stats.select(
        F.greatest(F.lit(1000), F.least(careful, F.lit(50000))).cast("bigint").alias("suggested_max"),
        (F.col("imbalance") > 50).alias("high_imbalance"))


def safe_cap(classes: DataFrame) -> DataFrame:
    """Cap at 80 % of the smallest class, the balanced size it gives, and the weighted plan's size."""
    keep = F.when(F.col("n") < 1000, F.col("n")).otherwise(F.least("n", F.lit(10000)))
    stats = classes.agg(F.least(F.floor(F.min("n") * 0.8), F.lit(50000)).alias("safe_max"),
                        F.count(F.lit(1)).alias("classes"), F.sum(keep).alias("weighted_size"))
    return stats.select("safe_max", (F.col("safe_max") * F.col("classes")).alias("balanced_size"), "weighted_size")


def profile_summary(df: DataFrame, distinct_of: list[str]) -> DataFrame:
    """Long-form profile: count, mean, std, min, max per numeric column; distinct values of the
    named columns. One aggregation, one row per column."""
    numeric = numeric_columns(df)
    stats = df.agg(
        *[F.count(c).alias(f"{c}__count") for c in df.columns],
        *[f(c).cast("double").alias(f"{c}__{name}") for c in numeric
          for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    none = F.lit(None).cast("double")
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__count").alias("n"),
                 *[(F.col(f"{c}__{s}") if c in numeric else none).alias(s) for s in ("mean", "std", "min", "max")])
        for c in df.columns])
    described = stats.select(F.explode(rows).alias("r")).select("r.*")
    # distinct counts by grouping, one column at a time: no set of values is ever built
    counted = None
    for c in distinct_of:
        part = df.select(F.col(c).cast("string").alias("v")).where("v is not null").distinct().agg(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("distinct_values"))
        counted = part if counted is None else counted.unionByName(part)
    return described.join(F.broadcast(counted), "column_name", "left")
