"""Mixing sources to target weights by entropy balancing.

Document rates stay as close to 1 as they can (in relative entropy, at most ``most`` copies) while
every source's expected tokens meet its target. The dual has one multiplier per source: the rate of a
document is ``min(most, exp(lambda * size / mean size of the source))``. Newton steps solve for all
multipliers at once, each step one Spark aggregate over the (source, size) histogram; a bracket keeps
a step from leaving the region where the root lies. Rates are then rounded to whole copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.words import slices, text_bytes, word_hashes
from packetloom.session import materialise

WEIGHTS = (5, 2, 1)
BUCKETS = 4096
# the table of (source, size) groups is broadcast up to this size, beyond it rows are joined by key
BROADCAST_BYTES = 32 << 20
CUT_BYTES = 96


def with_sizes(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``size``, the number of words of ``text`` (null: 0)."""
    schema = T.StructType([*[T.StructField(k, docs.schema[k].dataType) for k in keep], T.StructField("size", T.LongType())])
    picked = docs.select(*[F.col(f"`{k}`") for k in keep], F.col("text").alias("_text"))

    def run(batches):
        for piece in slices(batches, "_text"):
            _, starts = word_hashes(*text_bytes(piece.column("_text")))
            yield pa.RecordBatch.from_arrays([*[piece.column(k) for k in keep], pa.array(np.diff(starts), pa.int64())], [*keep, "size"])

    return picked.mapInArrow(run, schema)


def targets(sizes: DataFrame, share: float, most: int, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, target) per source: water-filling of ``share`` of all words by weight.

    One row per source: the windows below see source totals, never documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(named) - 1) % len(weights)
    weighted = totals.select("*", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("weight"))
    # sources fill up in the order of cap / weight; the level is the first one the rest can share
    weighted = weighted.withColumn("cap", F.col("source_size") * float(most)).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = weighted.select(
        "*", F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("filled"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
        (F.sum("source_size").over(every) * share).alias("all"))
    level = level.withColumn("level", (F.col("all") - F.col("filled")) / F.col("open"))
    level = level.withColumn("mu", F.min_by("level", F.when(F.col("level") <= F.col("full_at"), F.col("full_at"))).over(every))
    return level.select("source", "source_size", F.least("cap", F.coalesce(F.col("mu") * F.col("weight"), F.col("cap"))).alias("target"))


def _rates(hist: DataFrame, goal: DataFrame, most: int, rounds: int, tolerance: float) -> DataFrame:
    """(source, size, n, rate): Newton's method on the dual, one aggregate a round."""
    means = hist.groupBy("source").agg(F.sum("n").alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    state = goal.join(means, goal["source"].eqNullSafe(means["source"])).drop(means["source"]).select(
        "source", "source_size", "target", (F.col("source_size") / F.col("docs")).alias("mean"),
        F.lit(0.0).alias("lam"), F.lit(-700.0).alias("low"), (F.log(F.lit(float(most))) * F.col("source_size") / F.col("docs") / F.col("least") + 1).alias("high"))
    state = materialise(state, "mixing-state")
    for _ in range(rounds):
        tilt = F.exp(F.greatest(F.col("lam") * F.col("size") / F.col("mean"), F.lit(-700.0)))
        rate = F.least(tilt, F.lit(float(most)))
        slope = F.when(tilt < most, tilt * F.col("size") / F.col("mean")).otherwise(0.0)
        s = state.select(F.col("source").alias("s"), "lam", "mean")
        sums = hist.where("size > 0").join(s, hist["source"].eqNullSafe(s["s"])).groupBy("s").agg(
            F.sum(rate * F.col("size") * F.col("n")).alias("got"), F.sum(slope * F.col("size") * F.col("n")).alias("grad"))
        step = state.join(sums, state["source"].eqNullSafe(sums["s"]), "left").drop("s")
        over = F.col("got") > F.col("target")
        step = step.withColumn("low", F.when(~over, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(over, F.col("lam")).otherwise(F.col("high")))
        newton = F.col("lam") - (F.col("got") - F.col("target")) / F.when(F.col("grad") > 0, F.col("grad"))
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        done = (F.abs(F.col("got") - F.col("target")) <= tolerance * F.col("target")) | F.col("got").isNull() | (F.col("target") >= F.col("source_size") * most)
        moved = F.when(done, F.col("lam")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = materialise(step.select("source", "source_size", "target", "mean", moved.alias("lam"), "low", "high", done.alias("done")), "mixing-state")
        if not state.where("not done").limit(1).count():
            break
    final = state.select(F.col("source").alias("s"), "source_size", "target", "mean", "lam")
    tilt = F.exp(F.greatest(F.col("lam") * F.col("size") / F.col("mean"), F.lit(-700.0)))
    rate = F.when(F.col("target") >= F.col("source_size") * most, F.lit(float(most))).otherwise(F.least(tilt, F.lit(float(most))))
    return hist.join(final, hist["source"].eqNullSafe(final["s"])).select("source", "size", "n", "target", "source_size", F.when(F.col("size") > 0, rate).otherwise(1.0).alias("rate"))


def _group_copies(rates: DataFrame, most: int) -> DataFrame:
    """Copies of each (source, size) group, largest sizes first, what rounding leaves is carried on.

    One source's groups are its distinct sizes: at most the square root of twice its words.
    """
    def run(key, group):
        group = group.sort_values("size", ascending=False)
        owed, copies = 0.0, []
        for size, n, rate in zip(group["size"], group["n"], group["rate"]):
            exact = n * rate + (owed / size if size else 0.0)
            k = int(min(max(round(exact), 0), most * n))
            owed += (n * rate - k) * size
            copies.append(k)
        return pd.DataFrame({"source": group["source"], "size": group["size"], "n": group["n"], "source_size": group["source_size"], "target": group["target"], "copies": copies})

    return rates.groupBy("source").applyInPandas(run, "source string, size long, n long, source_size long, target double, copies long")


def _bucket() -> Column:
    return F.pmod(F.col("_hash"), F.lit(BUCKETS))


def _cuts(sizes: DataFrame, groups: DataFrame) -> DataFrame:
    """``groups`` with the hash up to which its rows get one more copy, found from counts alone.

    Rows are ordered by (bucket, hash). Bucket counts name the bucket of the cut, and only that bucket's
    rows are counted by hash. Of the rows with the cut's own hash ``_cut_left`` are in; ``_tied`` says
    that not all of them are.
    """
    keys = ["source", "size"]
    first = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    counts = sizes.groupBy(*keys, _bucket().alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(first(*keys, "_bucket")), F.lit(0)))
    asked = groups.where("_more > 0").select("_source", "_size", "_more")
    hit = counts.join(asked, counts["source"].eqNullSafe(asked["_source"]) & (counts["size"] == asked["_size"])).where(
        "_before < _more and _more <= _before + _n").select("_source", "_size", F.col("_bucket").alias("_cut_bucket"), (F.col("_more") - F.col("_before")).alias("_left"))
    inside = sizes.join(hit, sizes["source"].eqNullSafe(hit["_source"]) & (sizes["size"] == hit["_size"]) & (_bucket() == hit["_cut_bucket"]))
    by_hash = inside.groupBy("_source", "_size", "_cut_bucket", "_left", "_hash").agg(F.count(F.lit(1)).alias("_n"))
    by_hash = by_hash.withColumn("_before", F.coalesce(F.sum("_n").over(first("_source", "_size", "_hash")), F.lit(0)))
    cut = by_hash.where("_before < _left and _left <= _before + _n").select(
        F.col("_source").alias("_s"), F.col("_size").alias("_z"), "_cut_bucket", F.col("_hash").alias("_cut_hash"),
        (F.col("_left") - F.col("_before")).alias("_cut_left"), (F.col("_before") + F.col("_n") > F.col("_left")).alias("_tied"))
    return groups.join(cut, groups["_source"].eqNullSafe(cut["_s"]) & (groups["_size"] == cut["_z"]), "left").select(
        "_source", "_size", "source_size", "target", "_each", "_cut_bucket", "_cut_hash", "_cut_left", F.coalesce("_tied", F.lit(False)).alias("_tied"))


def mix_sources(
    docs: DataFrame, keep: list[str] = ("doc_id",), share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS,
    rounds: int = 60, tolerance: float = 1e-6,
) -> DataFrame:
    """The columns ``keep`` with size, source_size, target, copies and taken per row of ``docs``.

    Sources in code point order (null last, as a source of its own) weigh ``weights`` in turn and share
    ``share`` of all words; no target exceeds ``most`` times its source. Null and empty texts have size
    0 and are kept once, taking no words. Which rows of equal source and size get the extra copy
    depends on a hash of the doc_id and text length alone, so reruns agree; repeated rows tie and are
    interchangeable. An empty table gives no rows. Extra columns are ignored unless kept. ``docs`` is read
    twice and must give the same rows both times.
    """
    keep = list(keep)
    columns = list(dict.fromkeys([*keep, "source", "doc_id"]))
    hashed = F.xxhash64("doc_id", "size")
    # texts are read for their sizes here and once more for the result: only narrow rows are written and shuffled
    sizes = materialise(with_sizes(docs, ["source", "doc_id"]).select("source", "size", hashed.alias("_hash")), "mixing-sizes")
    hist = materialise(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mixing-histogram")
    goal = targets(hist.select("source", (F.col("size") * F.col("n")).alias("size")), share, most, weights)
    groups = _group_copies(_rates(hist, goal, most, rounds, tolerance), most)
    groups = materialise(groups.select(
        F.col("source").alias("_source"), F.col("size").alias("_size"), "source_size", "target",
        F.floor(F.col("copies") / F.col("n")).cast("long").alias("_each"), (F.col("copies") % F.col("n")).alias("_more")), "mixing-groups")
    cuts = materialise(_cuts(sizes, groups), "mixing-cuts")
    width = cuts.agg(F.sum(F.coalesce(F.octet_length("_source"), F.lit(0)) + CUT_BYTES)).first()[0] or 0
    few = F.broadcast(cuts) if width <= BROADCAST_BYTES else cuts
    rows = with_sizes(docs, columns).withColumn("_hash", hashed).withColumn("_bucket", _bucket())
    rows = rows.join(few, rows["source"].eqNullSafe(few["_source"]) & (rows["size"] == few["_size"]))
    below = (F.col("_bucket") < F.col("_cut_bucket")) | ((F.col("_bucket") == F.col("_cut_bucket")) & (F.col("_hash") <= F.col("_cut_hash")))
    more = F.coalesce(below, F.lit(False)).cast("long")
    if cuts.where("_tied").limit(1).count():
        # rows that share the hash at the cut (one doc_id, or none): they alone are ranked
        at_cut = F.coalesce(F.col("_tied") & (F.col("_hash") == F.col("_cut_hash")), F.lit(False))
        rank = F.row_number().over(Window.partitionBy("_source", "_size").orderBy("doc_id"))
        tied = rows.where(at_cut).withColumn("_extra", (rank <= F.col("_cut_left")).cast("long"))
        rows = rows.where(~at_cut).withColumn("_extra", more).unionByName(tied)
    else:
        rows = rows.withColumn("_extra", more)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("_each") + F.col("_extra"))
    return rows.select(*[F.col(f"`{k}`") for k in keep], "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
