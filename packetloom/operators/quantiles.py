"""Exact percentiles of large columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT_ROWS = 5_000_000
SKETCH_SIZE = 2048  # of a quantile sketch, whose rank error is then well below MARGIN
MARGIN = 0.005


@dataclass
class _Bracket:
    """Bounds around the wanted ranks of a column; None: open on that side."""

    total: int
    inside: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    margin: float = MARGIN

    def holds(self, value: Column) -> Column:
        test = value.isNotNull()
        if self.low is not None:
            test = test & (value >= self.low)
        return test if self.high is None else test & (value <= self.high)


def exact_percentiles(df: DataFrame, columns: list[str], p: float, exact_rows: int = EXACT_ROWS) -> dict[str, float | None]:
    """Linear-interpolated percentile ``p`` per column over its non-null values.

    Columns with more than ``exact_rows`` values are bracketed around the wanted rank by quantile
    sketches first, all columns in one job, as often as needed. The values inside the brackets then meet
    in long form: they are counted by (column, value) and ranked column by column, so that no task holds
    the values of all columns. The number of jobs does not depend on the number of columns.
    """
    if not columns:
        return {}
    source = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    counts = source.agg(*[F.count(c).alias(c) for c in columns]).first()
    brackets = {c: _Bracket(counts[c], counts[c]) for c in columns if counts[c]}
    wanted = {c: p * (b.total - 1) for c, b in brackets.items()}

    large = [c for c, b in brackets.items() if b.inside > exact_rows]
    while large:
        large = _narrowed(source, brackets, wanted, large, exact_rows)

    ranks = {c: (math.floor(r), math.ceil(r)) for c, r in wanted.items()}
    found = _values_at(source, brackets, ranks)
    result: dict[str, float | None] = dict.fromkeys(columns)
    for c, (k, after) in ranks.items():
        lo, hi = found[c, k], found[c, after]
        result[c] = lo if k == after or lo == hi else (after - wanted[c]) * lo + (wanted[c] - k) * hi
    return result


def _narrowed(source: DataFrame, brackets: dict[str, _Bracket], wanted: dict[str, float], large: list[str], exact_rows: int) -> list[str]:
    """Narrow the brackets of some columns in two jobs; returns those still too wide."""
    ends = []
    for c in large:
        b = brackets[c]
        share = (wanted[c] - b.below) / max(b.inside - 1, 1)
        sketch = F.kll_sketch_agg_double(F.when(b.holds(F.col(c)), F.col(c)), F.lit(SKETCH_SIZE))
        ends += [F.kll_sketch_get_quantile_double(sketch, F.lit(min(max(share + side * b.margin, 0.0), 1.0))).alias(f"{c}_{side}") for side in (-1, 1)]
    at = source.agg(*ends).first()
    tried = {c: _Bracket(brackets[c].total, 0, at[f"{c}_-1"], at[f"{c}_1"], margin=brackets[c].margin) for c in large}
    seen = source.agg(*[F.count_if(F.col(c) < b.low).alias(f"{c}_b") for c, b in tried.items()],
                      *[F.count_if(b.holds(F.col(c))).alias(f"{c}_i") for c, b in tried.items()]).first()
    still = []
    for c, b in tried.items():
        b.below, b.inside = seen[f"{c}_b"], seen[f"{c}_i"]
        if not b.below <= math.floor(wanted[c]) <= math.ceil(wanted[c]) < b.below + b.inside:
            brackets[c].margin *= 4  # the sketch was off: try again with more room
            if brackets[c].margin < 1:
                still.append(c)
            continue
        # a bracket that stops shrinking holds few distinct values: they are counted as they are
        shrunk = b.inside < brackets[c].inside
        brackets[c] = b
        if b.inside > exact_rows and shrunk and b.low < b.high:
            still.append(c)
    return still


def _values_at(source: DataFrame, brackets: dict[str, _Bracket], ranks: dict[str, tuple[int, int]]) -> dict[tuple[str, int], float]:
    """The values at the given ranks (from 0) of every column."""
    if not brackets:
        return {}
    names = list(brackets)
    entries = F.array_compact(F.array(*[
        F.when(brackets[c].holds(F.col(c)), F.struct(F.lit(i).alias("i"), F.col(c).alias("v"))) for i, c in enumerate(names)]))
    counted = source.select(F.explode(entries).alias("e")).groupBy("e.i", "e.v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("v"))
    wanted = F.array(*[F.array(*[F.lit(r - brackets[c].below).cast("long") for r in ranks[c]]) for c in names])[F.col("i")]
    ranked = counted.select("i", "v", (upto - F.col("n")).alias("first"), upto.alias("behind"), wanted.alias("ranks"))
    hit = lambda r: (r >= F.col("first")) & (r < F.col("behind"))
    rows = ranked.where(hit(F.col("ranks")[0]) | hit(F.col("ranks")[1])).collect()  # two rows a column at most
    found = {}
    for row in rows:
        for r in ranks[names[row["i"]]]:
            if row["first"] <= r - brackets[names[row["i"]]].below < row["behind"]:
                found[names[row["i"]], r] = row["v"]
    return found
