"""Written tables: kept until the result that needs them is written, then deleted."""

import os

from pyspark.sql import functions as F

from packetloom.session import CLEANUP_CONF, materialise, settled


def _folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_settled_deletes_only_its_own_steps(spark):
    outside = materialise(spark.range(10), "outside")
    seen = []

    def inner():
        step = materialise(outside.groupBy((F.col("id") % 3).alias("k")).count(), "inner")
        seen.append(_folder(step))
        return step.where("k > 0")

    def outer():
        table = settled(spark, inner, "middle")
        seen.append(_folder(table))
        return table.select("k")

    result = settled(spark, outer, "result")
    assert sorted(r.k for r in result.collect()) == [1, 2]
    assert outside.count() == 10
    assert not any(os.path.exists(p) for p in seen)


def test_materialise_leaves_the_cleanup_setting_as_it_was(spark):
    before = spark.conf.get(CLEANUP_CONF)
    keyed = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert materialise(keyed).count() == 7
    assert keyed.count() == 7  # the same frame again, its shuffle files gone
    assert spark.conf.get(CLEANUP_CONF) == before
