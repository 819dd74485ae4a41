"""Ordered scans that stay balanced when one key holds a large share of the rows.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. Here the order column is
cut into chunks of about equal row count; each (key, chunk) is scanned on its own and starts from
a carry row that summarises the key's earlier chunks. The summaries come from a map-side combined
``groupBy``, so only one row per (key, chunk) ever meets in a per-key window. Tables that fit in
one chunk get the plain window.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CHUNK_CONF = "packetloom.rowsPerChunk"
DEFAULT_ROWS_PER_CHUNK = 1_000_000
MAX_CHUNKS = 10_000  # also bounds the carry window of one key


@dataclass(frozen=True)
class Cuts:
    """Inner cut points of an order column; none means the table is one chunk."""

    column: str
    points: tuple[float, ...] = ()

    @property
    def single(self) -> bool:
        return not self.points


def rows_per_chunk(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(ROWS_PER_CHUNK_CONF, str(DEFAULT_ROWS_PER_CHUNK)))


def cut_points(df: DataFrame, column: str, limit: int | None = None) -> Cuts:
    """Equal-depth cuts of ``column``. Reads that column only; one pass, two for large tables."""
    limit = limit or rows_per_chunk(df)
    only = df.select(F.col(column).cast("double").alias(column))
    n = only.count()
    if n <= limit:
        return Cuts(column)
    chunks = min(math.ceil(n / limit), MAX_CHUNKS)
    probabilities = [i / chunks for i in range(1, chunks)]
    points = only.approxQuantile(column, probabilities, 1.0 / (2 * chunks))
    return Cuts(column, tuple(sorted(set(points))))


def with_chunk(df: DataFrame, cuts: Cuts) -> DataFrame:
    """Add ``_chunk``, a non-decreasing function of the cut column."""
    bucketizer = Bucketizer(
        splits=[-float("inf"), *cuts.points, float("inf")],
        inputCol="_cut", outputCol="_chunk", handleInvalid="keep",
    )
    cut = df.withColumn("_cut", F.col(cuts.column).cast("double"))
    return bucketizer.transform(cut).drop("_cut").withColumn("_chunk", F.col("_chunk").cast("int"))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    cuts: Cuts,
    sums: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    maxs: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    prevs: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running values per key in ``order``; each argument maps a new column to its input.

    ``sums``, ``mins``, ``maxs`` include the current row, ``lasts`` is the latest non-null value
    up to it, ``prevs`` the value of the row before. ``order`` starts with the cut column and is
    ascending. Sums keep the input type: pass bigint or double.
    """
    groups = {"sum": sums or {}, "min": mins or {}, "max": maxs or {}, "last": lasts or {}, "prev": prevs or {}}
    inputs = {out: col for group in groups.values() for out, col in group.items()}
    kind = {out: name for name, group in groups.items() for out in group}
    if cuts.single:
        by_key = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
        frame = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[
            _running_value(kind[out], col, by_key, frame).alias(out) for out, col in inputs.items()
        ])

    rows = with_chunk(df, cuts).select("*", *[col.alias(f"_in_{out}") for out, col in inputs.items()])
    at = F.struct(*order)
    summary = rows.groupBy(*keys, "_chunk").agg(*[
        _chunk_value(kind[out], F.col(f"_in_{out}"), at).alias(f"_in_{out}") for out in inputs
    ])
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk") if keys else Window.orderBy("_chunk")
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys, "_chunk", F.count(F.lit(1)).over(earlier).alias("_earlier"),
        *[_carry_value(kind[out], F.col(f"_in_{out}"), earlier).alias(f"_in_{out}") for out in inputs],
    ).where("_earlier > 0").drop("_earlier")

    both = rows.withColumn("_real", F.lit(1)).unionByName(
        carry.withColumn("_real", F.lit(0)), allowMissingColumns=True)
    by_key = Window.partitionBy(*keys, "_chunk").orderBy("_real", *order)
    frame = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = both.select("*", *[
        _running_value(kind[out], F.col(f"_in_{out}"), by_key, frame).alias(out) for out in inputs
    ])
    return scanned.where("_real = 1").drop("_real", "_chunk", *[f"_in_{out}" for out in inputs])


def _running_value(kind: str, col: Column, by_key, frame) -> Column:
    if kind == "prev":
        return F.lag(col, 1).over(by_key)
    return {
        "sum": lambda: F.sum(col), "min": lambda: F.min(col), "max": lambda: F.max(col),
        "last": lambda: F.last(col, ignorenulls=True),
    }[kind]().over(frame)


def _chunk_value(kind: str, col: Column, at: Column) -> Column:
    if kind == "prev":
        return F.max_by(col, at)
    if kind == "last":
        return F.max_by(col, F.when(col.isNotNull(), at))
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](col)


def _carry_value(kind: str, col: Column, earlier) -> Column:
    if kind == "prev":
        return F.last(col).over(earlier)
    if kind == "last":
        return F.last(col, ignorenulls=True).over(earlier)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](col).over(earlier)


def trailing(
    df: DataFrame, keys: list[str], ts: str, row_id: str, width: float, sums: dict[str, Column],
    cuts: Cuts | None = None,
) -> DataFrame:
    """Sums over the rows of the key in ``[ts - width, ts]`` up to and including the current row.

    Every row re-enters as a negative row at ``ts + width``, so the frame sum becomes a running
    sum: linear work however many rows a frame holds. Rows that leave at the time of another row
    sort after it, which keeps the lower bound inclusive.
    """
    rows = df.select("*", *[col.alias(f"_add_{out}") for out, col in sums.items()],
                     F.col(ts).alias("_at"), F.lit(0).alias("_leave"))
    leaving = rows.select(
        *keys, row_id, (F.col(ts) + F.lit(float(width))).alias("_at"), F.lit(1).alias("_leave"),
        *[(-F.col(f"_add_{out}")).alias(f"_add_{out}") for out in sums],
    )
    both = rows.unionByName(leaving, allowMissingColumns=True)
    cuts = Cuts("_at", (cuts or cut_points(df, ts)).points)
    scanned = running(both, keys, ["_at", "_leave", row_id], cuts,
                      sums={out: F.col(f"_add_{out}") for out in sums})
    return scanned.where("_leave = 0").drop("_at", "_leave", *[f"_add_{out}" for out in sums])


def session_cells(
    df: DataFrame, keys: list[str], ts: str, gap: float, *aggs: Column, inclusive: bool = False,
) -> DataFrame:
    """Aggregates per (key, cell of ``gap`` seconds), each with its gap session's start.

    Two rows of a cell are less than ``gap`` apart, so a cell never spans two sessions: rows are
    pre-aggregated to cells first and only cells meet in the per-key window. A new session starts
    after a pause longer than ``gap`` (``inclusive``: at least ``gap``). Adds ``_cell``,
    ``_first``, ``_last`` and ``_session`` (start of the session).
    """
    cells = df.groupBy(*keys, F.floor(F.col(ts) / F.lit(float(gap))).alias("_cell")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), *aggs)
    by_key = Window.partitionBy(*keys).orderBy("_cell")
    pause = F.col("_first") - F.lag("_last").over(by_key)
    fresh = pause.isNull() | ((pause >= gap) if inclusive else (pause > gap))
    marked = cells.withColumn("_fresh", F.when(fresh, F.col("_first")))
    return marked.withColumn("_session", F.last("_fresh", ignorenulls=True).over(by_key)).drop("_fresh")
