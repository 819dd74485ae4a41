"""Exact nearest neighbours without comparing every pair of rows.

Reference rows are assigned to the nearest of a bounded set of pivots and cut into blocks of at
most ``block_rows``. A query first searches its own pivot's cell; the k-th distance found there
rules out, by the triangle inequality, every cell that cannot hold a closer row, and only the
remaining cells are searched. Blocks of hot cells are separate tasks, each task returns at most k
rows per query, and the result is exact.

Inside a task most pairs are only estimated (a matrix product, or sums of larger components in
single precision): a pair whose estimate lies beyond the k-th distance by more than its rounding
error can be no neighbour. The distances of the few pairs left are computed in full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.lookups import small_side
from packetloom.session import materialise

PIVOTS = 256
BLOCK_ROWS = 20_000
CELL_ROWS = 50_000
QUERY_ROWS = 1024  # estimated at a time against SLICE_ROWS
SLICE_ROWS = 4096
PAIR_ROWS = 50_000  # computed in full at a time
SEARCH_TASKS = 2048


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance matrix in double precision, a slice of ``a`` at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.abs(diff).sum(axis=2) if metric == "manhattan" else np.sqrt((diff * diff).sum(axis=2))
    return out


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=float)


def _pair_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of ``a`` to the same row of ``b``, to the last bit as in ``_distances``."""
    diff = a - b
    return np.abs(diff).sum(axis=1) if metric == "manhattan" else np.sqrt((diff * diff).sum(axis=1))


def _sums_of_larger(q: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sum over the components of the larger of the two, for every pair; ``columns`` holds a component per row.
    Worked off in tiles that stay in the processor's cache."""
    out = np.empty((len(q), columns.shape[1]), dtype=q.dtype)
    for i in range(0, len(q), 16):
        for j in range(0, columns.shape[1], 4096):
            some, of = q[i:i + 16], columns[:, None, j:j + 4096]
            total = np.zeros((len(some), of.shape[2]), dtype=q.dtype)
            larger = np.empty_like(total)
            for c in range(q.shape[1]):
                np.maximum(some[:, c, None], of[c], out=larger)
                np.add(total, larger, out=total)
            out[i:i + 16, j:j + 4096] = total
    return out


class _Estimate:
    """Figures that order the rows of a block by their distance to a query, up to a known error.

    ``figures`` of a pair is at most ``level`` of any bound its distance keeps.
    """

    def __init__(self, rows: np.ndarray, metric: str):
        self.metric, self.rows = metric, rows
        self.centre = rows.mean(axis=0)  # distances stay, rounding errors shrink
        near = rows - self.centre
        sizes = np.abs(near).sum(axis=1)
        self.raw = np.abs(rows).sum(axis=1).max()
        self.largest = sizes.max()
        # squares and single precision have a narrower range than the values; beyond it nothing is estimated
        self.usable = bool(self.raw < (1e30 if metric == "manhattan" else 1e100))
        if not self.usable:
            return
        if metric == "manhattan":
            self.parts = np.ascontiguousarray(near.T.astype(np.float32))
            self.own = (near.sum(axis=1) / 2).astype(np.float32)
        else:
            self.parts = np.ascontiguousarray(np.column_stack([-2 * near, (near * near).sum(axis=1)]).T)

    def prepared(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        near = q - self.centre
        raw, wide = np.abs(q).sum(axis=1), np.abs(near).sum(axis=1) + self.largest
        off = 1e-14 * (raw + self.raw)  # of the shift to the centre
        dims = q.shape[1] + 8
        if not (self.usable and raw.max() < (1e30 if self.metric == "manhattan" else 1e100)):
            return q, np.zeros(len(q)), np.zeros(len(q)), False
        if self.metric == "manhattan":
            return near.astype(np.float32), near.sum(axis=1) / 2, 2.5e-7 * dims * wide + off + 1e-30, True
        return (np.column_stack([near, np.ones(len(q))]), (near * near).sum(axis=1),
                (1e-15 * dims * wide + 4 * off) * wide + off * off + 1e-290, True)

    def figures(self, prepared: tuple, begin: int, end: int) -> np.ndarray:
        q, _, _, usable = prepared
        if not usable:
            return _distances(q, self.rows[begin:end], self.metric)
        if self.metric == "manhattan":
            return _sums_of_larger(q, self.parts[:, begin:end]) - self.own[begin:end]
        return q @ self.parts[:, begin:end]

    def level(self, prepared: tuple, bound: np.ndarray) -> np.ndarray:
        _, own, error, usable = prepared
        if not usable:
            return bound
        return bound / 2 + own + error if self.metric == "manhattan" else bound * bound - own + error


def _few_copies(rows: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among the k nearest of some query: of equal vectors those with the
    smallest ids, k of an id and 2k in all, so that k stay when a query leaves one id out."""
    kinds, different = pd.factorize(np.array([row.tobytes() for row in rows], dtype=object))
    if len(different) == len(rows):
        return np.arange(len(rows))
    by = pd.DataFrame({"kind": kinds, "id": ids}).sort_values("id", kind="stable")
    by = by[by.groupby(["kind", "id"], dropna=False).cumcount() < k]
    return np.sort(by.index[by.groupby("kind").cumcount() < 2 * k].to_numpy())


def _k_nearest(
    q: np.ndarray, q_ids: np.ndarray, reach: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, metric: str, exclude_self: bool,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, distance) of the k nearest rows of each query, ties by id; none beyond ``reach``."""
    found = [(np.empty(0, dtype=np.int64), ids[:0], np.empty(0))]
    usable, kept = np.flatnonzero(np.isfinite(q).all(axis=1)), np.isfinite(rows).all(axis=1)
    rows, ids = rows[kept], ids[kept]  # others are at no finite distance from anything
    kept = _few_copies(rows, ids, k)
    rows, ids = rows[kept], ids[kept]
    if len(rows) and len(usable):
        estimate = _Estimate(rows, metric)
        for start in range(0, len(usable), QUERY_ROWS):
            at = usable[start:start + QUERY_ROWS]
            place, i, d = _nearest_of_some(q[at], q_ids[at], reach[at], rows, ids, k, metric, exclude_self, estimate)
            found.append((at[place], i, d))
    return tuple(np.concatenate(part) for part in zip(*found))


def _nearest_of_some(q, q_ids, reach, rows, ids, k, metric, exclude_self, estimate) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    prepared = estimate.prepared(q)
    level = estimate.level(prepared, reach)
    error = prepared[2]
    place, best_ids, best = np.empty(0, dtype=np.int64), ids[:0], np.empty(0)
    for begin in range(0, len(rows), SLICE_ROWS):
        end = min(begin + SLICE_ROWS, len(rows))
        figures = estimate.figures(prepared, begin, end)
        possible = figures <= level[:, None].astype(figures.dtype)
        if np.count_nonzero(possible) > 8 * k * len(q) and end - begin > k:
            # too many: the k-th figure of this slice bounds them
            if exclude_self:
                figures[q_ids[:, None] == ids[None, begin:end]] = np.inf
            kth = np.partition(figures, k - 1, axis=1)[:, k - 1].astype(float)
            level = np.fmin(level, kth + 2 * error)
            possible = figures <= level[:, None].astype(figures.dtype)
        at, row = np.nonzero(possible)
        row += begin
        if exclude_self:
            other = q_ids[at] != ids[row]
            at, row = at[other], row[other]
        for i in range(0, len(at), PAIR_ROWS):
            a, r = at[i:i + PAIR_ROWS], row[i:i + PAIR_ROWS]
            d = _pair_distances(q[a], rows[r], metric)
            within = np.isfinite(d) & (d <= reach[a])
            place, best_ids, best = (np.concatenate(pair) for pair in (
                (place, a[within]), (best_ids, ids[r[within]]), (best, d[within])))
            order = np.lexsort((best_ids, best, place))
            place, best_ids, best = place[order], best_ids[order], best[order]
            rank = np.arange(len(place)) - np.searchsorted(place, place, side="left")
            top = rank < k
            last = rank == k - 1
            reach = reach.copy()
            reach[place[last]] = best[last]
            place, best_ids, best = place[top], best_ids[top], best[top]
        level = np.fmin(level, estimate.level(prepared, reach))
    return place, best_ids, best


def _pivots(reference: DataFrame, vector: str, row_id: str, count: int) -> np.ndarray:
    """A bounded, reproducible draw of reference rows: those with the smallest id hashes."""
    rows = reference.select(F.col(vector).alias("v"), F.xxhash64(row_id).alias("h"), F.col(row_id).alias("i")).orderBy("h", "i").limit(count).select("v").collect()
    return np.array([r.v for r in rows], dtype=float)


def _with_pivot_distances(df: DataFrame, vector: str, pivots: np.ndarray, metric: str) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def to_pivots(v: pd.Series) -> pd.Series:
        return pd.Series(list(_distances(_matrix(v), pivots, metric)))

    return df.withColumn("_d", to_pivots(F.col(vector).cast("array<double>")))


def nearest(
    queries: DataFrame, reference: DataFrame, k: int, vector: str = "embedding", row_id: str = "vec_id",
    metric: str = "euclidean", within: str | None = None, exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS, pivots: int | None = None,
) -> DataFrame:
    """(query_id, neighbour_id, distance, rank) of the k nearest reference rows; ties by id.

    ``within`` restricts neighbours to rows with the same value of a column (a class).
    """
    group = [within] if within else []
    largest = reference.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    # as many pivots as blocks: a query is sent to each cell it cannot rule out, so cells should be worth the journey
    drawn = _pivots(reference, vector, row_id, pivots or int(min(PIVOTS, max(1, largest // block_rows))))
    # searches are dealt by their work, not by their bytes: small tables in smaller parts, so that all cores get some
    partitions = int(reference.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part_rows = int(min(block_rows, max(QUERY_ROWS, largest * largest // (block_rows * partitions))))
    tasks = max(partitions, min(SEARCH_TASKS, len(drawn) * -(-largest // part_rows)))
    ref = _with_pivot_distances(reference.select(row_id, vector, *group), vector, drawn, metric)
    ref = ref.withColumn("cell", F.array_position("_d", F.array_min("_d")).cast("int")).withColumn("to_pivot", F.array_min("_d"))
    cells = ref.groupBy(*group, "cell").agg(F.count(F.lit(1)).alias("n"), F.min("to_pivot").alias("near"), F.max("to_pivot").alias("far"))
    cells = cells.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
    # without classes there are at most PIVOTS cells; with classes the check decides
    checked = small_side(cells, CELL_ROWS)
    bounded, cells = checked is not cells, checked
    hint = F.broadcast if bounded else (lambda df: df)
    keyed = [*group, "cell"]
    ref_blocks = ref.join(hint(cells.select(*keyed, "blocks")), keyed).select(
        *keyed, F.pmod(F.xxhash64(row_id), "blocks").cast("int").alias("block"),
        F.col(row_id).alias("neighbour_id"), F.col(vector).alias("neighbour_vector"))

    query = _with_pivot_distances(queries.select(F.col(row_id).alias("query_id"), F.col(vector).alias("query_vector"), *group), vector="query_vector", pivots=drawn, metric=metric)
    # home: the occupied cell whose pivot is nearest
    listed = cells.groupBy(*group).agg(F.collect_list(F.struct("cell", "near", "far", "blocks")).alias("cells"))
    query = query.join(hint(listed), group) if group else query.withColumn("cells", listed.scalar())
    home = F.array_min(F.transform("cells", lambda c: F.struct(F.element_at("_d", c["cell"]).alias("d"), c["cell"].alias("cell"))))["cell"]
    query = query.withColumn("home", home)

    def search(wanted: DataFrame) -> DataFrame:
        """Best k per query and block for (query, cell) requests, none beyond a query's ``reach``.
        Requests of a cell are dealt over tasks of at most about ``block_rows`` queries."""
        demand = wanted.groupBy(*keyed).agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
        demand = hint(demand)  # at most one row per cell
        spread = wanted.join(demand, keyed).withColumn("part", F.pmod(F.xxhash64("query_id"), "parts").cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        copies = ref_blocks.join(demand, keyed).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = [*keyed, "block", "part"]
        # both sides come from one table; fresh column identities keep the cogroup unambiguous
        copies = copies.select(*[F.col(c).alias(c) for c in (*keys, "neighbour_id", "neighbour_vector")])

        def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(r):
                return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "neighbour_id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
            q_ids = q["query_id"].to_numpy()
            reach = q["reach"].to_numpy(dtype=float, na_value=np.inf)
            place, ids, distance = _k_nearest(
                _matrix(q["query_vector"]), q_ids, reach, _matrix(r["neighbour_vector"]), r["neighbour_id"].to_numpy(), k, metric, exclude_self)
            return pd.DataFrame({"query_id": q_ids[place], "neighbour_id": ids, "distance": distance})

        return spread.repartition(tasks, *keys).groupBy(*keys).cogroup(copies.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(
            best, "query_id long, neighbour_id long, distance double")

    ranked = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    carried = [*group, "query_id", "query_vector"]
    blocks_of = lambda cell: F.filter("cells", lambda c: c["cell"] == cell)[0]["blocks"]
    first = search(query.select(*carried, F.lit(None).cast("double").alias("reach"), F.col("home").alias("cell"), blocks_of(F.col("home")).alias("blocks")))
    top = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    if len(drawn) == 1:
        return top
    top = materialise(top, "nearest")  # read for the bounds and for the result
    bound = top.groupBy("query_id").agg(F.max("distance").alias("reach"), F.count(F.lit(1)).alias("found")).select(
        "query_id", F.when(F.col("found") >= k, F.col("reach")).alias("reach"))
    limited = query.join(bound, "query_id", "left")

    def possible(c: Column) -> Column:
        """|q - pivot| - far <= reach and near - |q - pivot| <= reach, or fewer than k found at home."""
        to_cell = F.element_at("_d", c["cell"])
        slack = F.lit(1e-9) * (F.lit(1.0) + to_cell)
        close = (to_cell - c["far"] <= F.col("reach") + slack) & (c["near"] - to_cell <= F.col("reach") + slack)
        return (c["cell"] != F.col("home")) & (F.col("reach").isNull() | close)

    wanted = limited.select(*carried, "reach", F.explode(F.filter("cells", possible)).alias("c"))
    second = search(wanted.select(*carried, "reach", F.col("c.cell").alias("cell"), F.col("c.blocks").alias("blocks")))
    merged = top.drop("rank").unionByName(second)
    return merged.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def knn_classify(
    test: DataFrame, train: DataFrame, k: int = 5, label: str = "label", vector: str = "embedding", row_id: str = "vec_id",
    weights: str = "uniform", metric: str = "euclidean", **search,
) -> DataFrame:
    """Predicted label per test row: vote of the k nearest training rows, smallest label on ties.

    Weighted by distance, an exact match outvotes everything else.
    """
    found = nearest(test, train, k, vector, row_id, metric, **search)
    votes = found.join(train.select(F.col(row_id).alias("neighbour_id"), F.col(label).alias("vote")), "neighbour_id")
    if weights == "distance":
        exact = F.max(F.col("distance") == 0).over(Window.partitionBy("query_id"))
        weight = F.when(exact, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    else:
        weight = F.lit(1.0)
    tally = votes.withColumn("w", weight).groupBy("query_id", "vote").agg(F.sum("w").alias("w"))
    return tally.groupBy("query_id").agg(F.min_by("vote", F.struct(-F.col("w"), "vote")).alias("predicted")).withColumnRenamed("query_id", row_id)
