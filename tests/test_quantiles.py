"""Exact percentiles over brackets and in long form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import quantiles


@pytest.mark.parametrize("exact_rows", [30, 700, 10**6])
def test_many_columns_of_all_kinds(spark, exact_rows):
    rng = np.random.default_rng(int(exact_rows))
    n = 4000
    columns = {"normal": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "constant": np.full(n, 7.0),
               "skewed": np.exp(rng.normal(0, 8, n)), "spike": np.where(rng.random(n) < 0.7, 1.0, rng.normal(size=n)), "two": np.arange(n) % 2.0}
    rows = [tuple(float(columns[c][i]) if (i + j) % 9 else None for j, c in enumerate(columns)) for i in range(n)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).withColumn("none", F.lit(None).cast("double"))
    for p in (0.0, 0.25, 0.5, 0.999, 1.0):
        got = quantiles.exact_percentiles(table, [*columns, "none"], p, exact_rows)
        for j, c in enumerate(columns):
            values = np.array([r[j] for r in rows if r[j] is not None])
            assert got[c] == pytest.approx(np.quantile(values, p), rel=1e-12), (c, p)
        assert got["none"] is None


def test_jobs_do_not_grow_with_columns(spark):
    table = spark.range(5000).select(*[(F.col("id") * (i + 1) % 997).cast("double").alias(f"c{i}") for i in range(12)])
    tracker = spark.sparkContext.statusTracker()

    def jobs(columns):
        group = f"quantiles-{len(columns)}"
        spark.sparkContext.setJobGroup(group, group)
        quantiles.exact_percentiles(table, columns, 0.5, 100)
        return len(tracker.getJobIdsForGroup(group))

    one, all_of_them = jobs(["c0"]), jobs([f"c{i}" for i in range(12)])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all_of_them <= 2 * one


def test_int_and_decimal_columns(spark):
    table = spark.sql("SELECT CAST(id AS INT) AS a, CAST(id / 4 AS DECIMAL(10, 2)) AS b FROM range(7)")
    assert quantiles.exact_percentiles(table, ["a", "b"], 0.5) == {"a": 3.0, "b": 0.75}
