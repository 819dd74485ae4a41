"""Oversampling of small classes: interpolation between neighbours, and its adaptive form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.lookups import small_side
from packetloom.operators.neighbours import nearest
from packetloom.session import materialise


def _unit(seed: int, *columns: str) -> Column:
    """Reproducible number in [0, 1) from a row's identity."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / float(1 << 30)


def _interpolate(wanted: DataFrame, neighbours: DataFrame, vectors: DataFrame, label: str, vector: str, row_id: str, seed: int) -> DataFrame:
    """One synthetic row per (row, copy) of ``wanted``: a point between the row and a neighbour."""
    pools = neighbours.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour_id"))).alias("pool"))
    drawn = wanted.join(pools, F.col(row_id) == F.col("query_id")).select(
        row_id, "copy", F.element_at("pool", (F.floor(_unit(seed, row_id, "copy") * F.size("pool")) + 1).cast("int"))["neighbour_id"].alias("partner"))
    a = vectors.select(row_id, F.col(label), F.col(vector).cast("array<double>").alias("a"))
    b = vectors.select(F.col(row_id).alias("partner"), F.col(vector).cast("array<double>").alias("b"))
    u = _unit(seed + 1, row_id, "copy")
    # each partner row is joined at most a few times: pools hold k rows per query
    return drawn.join(a, row_id).join(b, "partner").withColumn("u", u).select(
        row_id, "partner", "copy", label, F.zip_with("a", "b", lambda x, y: x + F.col("u") * (y - x)).alias(vector))


def smote(df: DataFrame, label: str = "label", vector: str = "embedding", row_id: str = "vec_id", k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows that lift every class to the size of the largest.

    ``row_id`` names a point of one class; rows that share it are copies of the point, searched once
    and counted for its share of new rows. ``k`` shrinks to the smallest class's points; classes of
    one point get none. Each row of a class receives its even share of copies, the first points (by
    id hash) one more.
    """
    return _smote(df, label, vector, row_id, k, seed, None)


def _smote(df: DataFrame, label: str, vector: str, row_id: str, k: int, seed: int, per_row: DataFrame | None) -> DataFrame:
    base, sizes = _points(df, label, vector, row_id)
    smallest = sizes.agg(F.min("points")).first()[0] or 0
    k = int(min(k, smallest - 1))
    if k < 1:
        return base.limit(0).select(row_id, F.col(row_id).alias("partner"), F.lit(0).alias("copy"), label, F.col(vector).cast("array<double>").alias(vector))
    largest = F.max("n").over(Window.partitionBy())  # one row per class
    needs = sizes.withColumn("need", largest - F.col("n")).where("need > 0")
    small = base.join(small_side(needs), label)
    if per_row is None:
        copies = _spread_evenly(small, label, row_id, seed)
    else:
        copies = small.join(per_row, row_id)
    wanted = copies.where("copies > 0").select(row_id, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    members = small.select(row_id, label, vector)
    found = nearest(members, members, k, vector, row_id, within=label, exclude_self=True)
    return _interpolate(wanted, found, members, label, vector, row_id, seed)


def _points(df: DataFrame, label: str, vector: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """Distinct points with the number of rows at each, and rows and points per class."""
    points = df.groupBy(row_id, label).agg(F.first(vector).alias(vector), F.count(F.lit(1)).alias("times"))
    return points, points.groupBy(label).agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("points"))


def _spread_evenly(rows: DataFrame, label: str, row_id: str, seed: int) -> DataFrame:
    """Copies per row that add up to the class need: floor of the mean, and one more for the rows
    with the smallest hashes. The extra ones are found by quota, not by ranking the class."""
    from packetloom.operators.sampling import split_by_quota

    rows = rows.withColumn("share", F.floor(F.col("need") * F.col("times") / F.col("n")))
    quotas = rows.groupBy(label).agg((F.max("need") - F.sum("share")).alias("quota"))
    split = split_by_quota(rows.select(row_id, label, "share"), label, quotas, seed, [row_id])
    return split.select(row_id, (F.col("share") + F.col("chosen").cast("int")).alias("copies"))


def adasyn(df: DataFrame, label: str = "label", vector: str = "embedding", row_id: str = "vec_id", k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows weighted towards rows with many neighbours of other classes.

    Falls back to even spreading when the smallest class is too small. A class none of whose points
    has a foreign neighbour gets none. Shared ids are copies of one point, as in ``smote``.
    """
    points, sizes = _points(df, label, vector, row_id)
    smallest = sizes.agg(F.min("points")).first()[0] or 0
    if min(k, smallest - 1) < 1:
        return smote(df, label, vector, row_id, k, seed)
    largest = F.max("n").over(Window.partitionBy())
    needs = sizes.withColumn("need", largest - F.col("n")).where("need > 0")
    small = points.join(small_side(needs.select(label, "need")), label)
    around = nearest(small.select(row_id, vector), points.select(row_id, vector), k, vector, row_id, exclude_self=True)
    labels = points.select(F.col(row_id).alias("neighbour_id"), F.col(label).alias("other"))
    share = around.join(labels, "neighbour_id").join(small.select(F.col(row_id).alias("query_id"), label, "need", "times"), "query_id").groupBy(
        "query_id", label, "need", "times").agg((F.avg((F.col("other") != F.col(label)).cast("double")) * F.first("times")).alias("ratio"))
    share = materialise(share, "share")  # read for the totals and for the rows
    totals = share.groupBy(label).agg(F.sum("ratio").alias("total"))
    per_row = share.join(small_side(totals), label).where("total > 0").select(
        F.col("query_id").alias(row_id), F.bround(F.col("ratio") / F.col("total") * F.col("need")).cast("int").alias("copies"))
    return _smote(df, label, vector, row_id, k, seed, per_row)


def duplicate_minorities(df: DataFrame, label: str) -> DataFrame:
    """Every row, and every row of a class other than the largest once more."""
    largest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by(label, F.struct("n", label)))
    return df.unionByName(df.where(F.col(label) != largest.scalar()))
