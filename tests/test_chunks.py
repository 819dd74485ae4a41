"""How large the chunks of ordered scans get by default."""

from pyspark.sql import functions as F

from packetloom.operators import rates
from packetloom.operators.timeline import cut_points


def test_a_task_orders_a_million_rows_not_four(spark):
    times = spark.range(1_600_000).select((F.col("id") * 0.25).alias("ts_s"))
    cuts = cut_points(times, "ts_s")
    assert not cuts.single
    per_chunk = times.groupBy(sum((F.col("ts_s") >= p).cast("int") for p in cuts.points)).count()
    assert max(r["count"] for r in per_chunk.collect()) <= 1_400_000


def test_rate_over_chunks(spark):
    packets = spark.range(1_100_000).select(F.col("id").alias("pkt_id"), (F.col("id") * 0.25).alias("ts_s"))
    found = rates.flood_rate(packets, 3.0)
    assert found.groupBy("pps").count().where("count = 1").count() == 40
    assert found.where("pps = 4.1 and is_flood").count() == 1_100_000 - 40
