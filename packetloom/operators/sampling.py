"""Exact stratified sampling that does not depend on partitioning.

Rows are ranked inside their class by a seeded hash of the row. Ranking a whole class would send a
class that holds most of the table to one task; instead the hash space is cut into buckets, a
small (class, bucket) count table finds the bucket in which each class reaches its quota, and only
the rows of that one bucket are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.lookups import small_side

BUCKETS = 65_536


def _hashed(df: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """Two independent hashes: the bucket, and the order inside it."""
    draw = F.xxhash64(F.lit(seed), *columns)
    return df.withColumn("_bucket", F.pmod(draw, F.lit(BUCKETS)).cast("int")).withColumn(
        "_order", F.xxhash64(F.lit(seed + 1), *columns))


def split_by_quota(df: DataFrame, label: str, quotas: DataFrame, seed: int = 42, row_id: list[str] | None = None) -> DataFrame:
    """Add ``chosen``: true for exactly ``min(quota, class size)`` rows of every class.

    ``quotas`` has one row per class (``label``, ``quota``). ``row_id`` names a unique key; without
    one the whole row is hashed, and copies of a row, being interchangeable, are counted and
    repeated instead of ranked one by one. Rows without a label belong to no class and are left out.
    """
    columns = df.columns
    quotas = small_side(quotas)
    hashed = _hashed(df, row_id or columns, seed)
    counts = hashed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # the bucket in which a class reaches its quota, and how many rows it still takes from it
    edges = filled.join(quotas, label).where(
        (F.col("before") < F.col("quota")) & (F.col("before") + F.col("n") >= F.col("quota"))
    ).select(label, F.col("_bucket").alias("_edge"), (F.col("quota") - F.col("before")).alias("_take"))
    # classes smaller than their quota have no edge: all their rows are taken
    limits = quotas.join(edges, label, "left").select(
        F.col(label).alias("_class"), F.coalesce("_edge", F.when(F.col("quota") <= 0, -1).otherwise(BUCKETS)).alias("_edge"),
        F.coalesce("_take", F.lit(0)).alias("_take"))
    placed = hashed.join(small_side(limits), F.col(label) == F.col("_class"))
    sure = placed.where(F.col("_bucket") != F.col("_edge")).select(*columns, (F.col("_bucket") < F.col("_edge")).alias("chosen"))
    at_edge = placed.where(F.col("_bucket") == F.col("_edge"))
    in_bucket = Window.partitionBy(label, "_bucket").orderBy("_order", *(row_id or columns))
    if row_id:
        ranked = at_edge.withColumn("_rank", F.row_number().over(in_bucket))
        edge = ranked.select(*columns, (F.col("_rank") <= F.col("_take")).alias("chosen"))
    else:
        copies = at_edge.groupBy(*columns, "_bucket", "_order", "_take").agg(F.count(F.lit(1)).alias("_copies"))
        earlier = in_bucket.rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("_take") - F.coalesce(F.sum("_copies").over(earlier), F.lit(0))
        taken = F.least(F.col("_copies"), F.greatest(F.lit(0), F.col("_taken")))
        repeated = F.array(F.struct(taken.alias("n"), F.lit(True).alias("chosen")),
                           F.struct((F.col("_copies") - taken).alias("n"), F.lit(False).alias("chosen")))
        parts = copies.withColumn("_taken", left).select(*columns, F.explode(repeated).alias("p")).where("p.n > 0")
        edge = parts.select(*columns, "p.chosen", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("p.n"))).alias("_i")).drop("_i")
    return sure.unionByName(edge)


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def train_test(df: DataFrame, label: str, test_size: float = 0.2, seed: int = 42, row_id: list[str] | None = None) -> DataFrame:
    """Add ``is_test``: a stratified split with ``round(n * test_size)`` test rows per class."""
    quotas = class_sizes(df, label).select(label, F.round(F.col("n") * test_size).cast("bigint").alias("quota"))
    return split_by_quota(df, label, quotas, seed, row_id).withColumnRenamed("chosen", "is_test")


def cap_classes(df: DataFrame, label: str, max_samples: int = 50_000, seed: int = 42, row_id: list[str] | None = None) -> DataFrame:
    """At most ``max_samples`` rows per class, drawn evenly from the whole class."""
    quotas = class_sizes(df, label).select(label, F.least("n", F.lit(max_samples)).alias("quota"))
    return split_by_quota(df, label, quotas, seed, row_id).where("chosen").drop("chosen")


def sample_per_class(df: DataFrame, label: str, n_samples: int | None = None, fraction: float | None = None,
                     seed: int = 42, row_id: list[str] | None = None) -> DataFrame:
    """``n_samples`` spread evenly over the classes, or a fraction of every class."""
    if (n_samples is None) == (fraction is None):
        raise ValueError("give n_samples or fraction")
    sizes = class_sizes(df, label).where(F.col(label).isNotNull())
    if n_samples is not None:
        classes = F.count(F.lit(1)).over(Window.partitionBy())  # one row per class
        quotas = sizes.select(label, F.least("n", F.floor(F.lit(n_samples) / classes)).alias("quota"))
    else:
        quotas = sizes.select(label, F.bround(F.col("n") * fraction).cast("bigint").alias("quota"))
    return split_by_quota(df, label, quotas, seed, row_id).where("chosen").drop("chosen")


def sample_rows(df: DataFrame, n_samples: int | None = None, fraction: float | None = None, seed: int = 42,
                row_id: list[str] | None = None) -> DataFrame:
    """Plain sample without classes, of exact size."""
    if (n_samples is None) == (fraction is None):
        raise ValueError("give n_samples or fraction")
    whole = df.withColumn("_all", F.lit(0))
    size = F.count(F.lit(1))
    quota = F.least(size, F.lit(n_samples)) if n_samples is not None else F.bround(size * fraction)
    quotas = whole.groupBy("_all").agg(quota.cast("bigint").alias("quota"))
    return split_by_quota(whole, "_all", quotas, seed, row_id).where("chosen").drop("chosen", "_all")
