"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets.

A hash function turns a unit vector by three rounds of random signs and a fast Hadamard transform and
names the nearest of the 2d signed axes. A table joins ``k`` functions to one key; a vector enters the
bucket of its own key and of its next best keys, those that give away least of the axes' length. ``k``
grows with the number of vectors, so that buckets hold few strangers, and tables are added until pairs
at exactly the threshold meet with the wanted probability, which is measured on random pairs.

Equal vectors are one class. Buckets are found from narrow (key, class) rows; only members of shared
buckets fetch their vectors. A bucket is cut into blocks of bounded size, and each pair of blocks is
compared by matrix products in a task of its own: no pairs leave it, but counts and a spanning forest
of the links. A pair that meets in several buckets counts where its smallest shared key is.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.components import components
from packetloom.llm.tables import only
from packetloom.llm.words import mix
from packetloom.session import materialise, settled

PROBES, NEXT = 4, 3  # keys of a vector in a table; axes of a function that these are made of
RECALL = 0.97  # of pairs at exactly the threshold; pairs above it meet more often
ROOM = 32  # buckets of a table for each vector, at least
TABLES_AT_ONCE = 4  # tables of one pass, which bounds the rows on disk
BLOCK = 2048  # members of a bucket compared with as many others by one task
ROWS = 2048  # vectors rotated at once
SMALL = 48  # buckets up to this size are compared side by side
_SALT = np.uint64(0x9E3779B97F4A7C15)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        out = np.empty_like(pairs)
        np.add(pairs[:, :, 0], pairs[:, :, 1], out=out[:, :, 0])
        np.subtract(pairs[:, :, 0], pairs[:, :, 1], out=out[:, :, 1])
        x, h = out.reshape(n, d), 2 * h
    return x * np.float32(1 / math.sqrt(d))


def padded(dim: int) -> int:
    return max(16, 1 << (dim - 1).bit_length())


class Index:
    """Keys of unit vectors of one dimension."""

    def __init__(self, dim: int, k: int, tables: int | None = None):
        self.dim, self.width, self.k = dim, padded(dim), k
        functions = 4 * k
        sets = np.array(list(itertools.combinations(range(functions), k)))
        self.sets = np.random.default_rng(k).permutation(sets)[:tables]
        self.signs = np.random.default_rng([dim, k]).choice(np.array([-1, 1], np.float32), (functions, 3, self.width))
        self.choices = np.array(list(itertools.product(range(NEXT), repeat=k)))

    def axes(self, x: np.ndarray, function: int) -> tuple[np.ndarray, np.ndarray]:
        """The best signed axes of every row and what each gives away."""
        y = np.zeros((len(x), self.width), np.float32)
        y[:, :self.dim] = x
        for signs in self.signs[function]:
            y = hadamard(y * signs)
        size = np.abs(y)
        best = np.argpartition(-size, NEXT, axis=1)[:, :NEXT]
        length = np.take_along_axis(size, best, 1)
        order = np.argsort(-length, axis=1, kind="stable")
        best, length = np.take_along_axis(best, order, 1), np.take_along_axis(length, order, 1)
        negative = np.take_along_axis(y, best, 1) < 0
        return (best * 2 + negative).astype(np.uint64), (length[:, :1] - length) ** 2

    def keys(self, x: np.ndarray, tables: range) -> np.ndarray:
        """(row, table, probe) bucket keys; the first probe is the vector's own key."""
        found = np.empty((len(x), len(tables), PROBES), np.uint64)
        for a in range(0, len(x), ROWS):
            part, axes = x[a:a + ROWS], {}
            for j, table in enumerate(tables):
                chosen = self.sets[table].tolist()
                for f in chosen:
                    if f not in axes:
                        axes[f] = self.axes(part, f)
                cost = sum(axes[f][1][:, self.choices[:, i]] for i, f in enumerate(chosen))
                best = self.choices[np.argsort(cost, axis=1, kind="stable")[:, :PROBES]]
                key = np.full(best.shape[:2], (self.dim << 32) + table, np.uint64)
                for i, f in enumerate(chosen):
                    key = mix(key * _SALT + np.take_along_axis(axes[f][0], best[:, :, i], 1))
                found[a:a + ROWS, j] = key
        return found


def key_length(n: int, dim: int) -> int:
    return max(2, math.ceil(math.log(ROOM * max(n, 1)) / math.log(2 * padded(dim))))


def tables_needed(dim: int, k: int, threshold: float, recall: float = RECALL, pairs: int = 2000) -> int:
    """Tables in which random pairs at exactly ``threshold`` meet with probability ``recall``."""
    index, rng = Index(dim, k), np.random.default_rng(dim)
    a, b = rng.normal(size=(2, pairs, max(dim, 2)))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = threshold * a + math.sqrt(1 - threshold ** 2) * b / np.linalg.norm(b, axis=1)[:, None]
    if dim < 2:
        return 1  # only two directions
    met = np.zeros(pairs, bool)
    for table in range(len(index.sets)):
        one = range(table, table + 1)
        met |= (index.keys(a, one)[:, 0, :, None] == index.keys(b, one)[:, 0, None]).any((1, 2))
        if met.mean() >= recall:
            return table + 1
    return len(index.sets)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the non-null lists of each length but 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)  # missing components become nan
    ends = np.cumsum(sizes)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, values[(ends[rows] - size)[:, None] + np.arange(size)]


def _named(vectors: DataFrame) -> DataFrame:
    """Rows with a 128-bit digest of their vector; null where it can link with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, fit = np.zeros((2, batch.num_rows), np.uint64), np.zeros(batch.num_rows, bool)
            for rows, x in by_length(batch.column("vec")):
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                bits = (x[good].astype(np.float64) + 0.0).view(np.uint64)  # -0.0 is 0.0
                place = np.arange(x.shape[1], dtype=np.uint64)
                for i in range(2):
                    h[i, rows[good]] = mix(mix(bits + (place + np.uint64(1 + i * 0x10000001)) * _SALT).sum(axis=1, dtype=np.uint64) + np.uint64(x.shape[1]))
                fit[rows[good]] = True
            named = [pa.array(x.view(np.int64), mask=~fit) for x in h]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *named, batch.column("vec")], ["vec_id", "h1", "h2", "vec"])

    kind = vectors.schema["vec"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id long, h1 long, h2 long, vec {kind}")


def _entries(classes: DataFrame, k: int, tables: range) -> DataFrame:
    """(key, h1) of every class in these tables."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Index] = {}
        for batch in batches:
            h1 = batch.column("h1").to_numpy()
            for rows, x in by_length(batch.column("vec")):
                dim = x.shape[1]
                index = known.setdefault(dim, Index(dim, k, tables.stop))
                keys = index.keys(unit(x), range(tables.start, min(tables.stop, len(index.sets)))).reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(h1[rows], keys.shape[1]))], ["key", "h1"])

    return classes.select("h1", "vec").mapInArrow(run, "key long, h1 long")


class Bucket:
    """Members of a run of (bucket, block pair) groups, in order."""

    def __init__(self, group: np.ndarray, key: np.ndarray, block: np.ndarray, same: np.ndarray, x: np.ndarray):
        self.group, self.key, self.block, self.same, self.x = group, key, block, same, x

    def pairs(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Members (i, j) of one group that reach the threshold; of two blocks if the group has two."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        starts = np.flatnonzero(np.diff(self.group, prepend=self.group[0] - 1))
        sizes = np.diff(np.append(starts, len(self.group)))
        size = np.repeat(sizes, sizes)
        small = np.flatnonzero(size <= SMALL)
        for lag in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
            i = small[small + lag < len(self.group)]
            i = i[self.group[i] == self.group[i + lag]]
            found.append(self._reach(i, i + lag, threshold))
        for a, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            for at in range(a, a + n, 512):
                to = min(at + 512, a + n)
                i, j = np.nonzero(self.x[at:to] @ self.x[at:a + n].T >= threshold - 1e-9)
                found.append(self._reach((i + at)[j > i], (j + at)[j > i], threshold))
        return tuple(np.concatenate(f) for f in zip(*found))

    def _reach(self, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        due = self.same[i] | (self.block[i] != self.block[j])
        i, j = i[due], j[due]
        near = [np.zeros(0, bool)]
        for a in range(0, len(i), 65536):
            near.append(np.einsum("ij,ij->i", self.x[i[a:a + 65536]], self.x[j[a:a + 65536]]) >= threshold)
        near = np.concatenate(near)
        return i[near], j[near]

    def first_meeting(self, i: np.ndarray, j: np.ndarray, index: Index) -> np.ndarray:
        """Whether the group's key is the smallest key that both members have."""
        members, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        keys = index.keys(self.x[members], range(len(index.sets)))
        i_at, j_at = place[:len(i)], place[len(i):]
        here = np.zeros(len(i), bool)
        for a in range(0, len(i), 8192):
            left, right = keys[i_at[a:a + 8192]], keys[j_at[a:a + 8192]]
            shared = (left[:, :, :, None] == right[:, :, None, :]).any(3)
            least = np.where(shared, left, np.uint64(2**64 - 1)).min(axis=(1, 2))
            here[a:a + 8192] = least == self.key[i[a:a + 8192]].view(np.uint64)
        return here


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A common label, the smallest member, for the nodes each link joins."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _verified(members: DataFrame, k: int, tables: int, threshold: float) -> DataFrame:
    """(h1, h2, n, a, b): copies of the classes linked with a class, and links that join them."""
    def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            ids = [table.column(c).to_numpy() for c in ("key", "lo", "hi")]
            changes = np.flatnonzero(np.any([np.diff(x) != 0 for x in ids], axis=0))
            cut = int(changes[-1]) + 1 if len(changes) else 0
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows:
            yield rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Index] = {}
        for table in whole_groups(batches):
            key, lo, hi, block, h1, h2, rep, copies = (
                table.column(c).to_numpy() for c in ("key", "lo", "hi", "block", "h1", "h2", "rep", "copies"))
            group = np.cumsum(np.any([np.diff(x, prepend=x[:1]) != 0 for x in (key, lo, hi)], axis=0))
            for rows, x in by_length(table.column("vec")):
                bucket = Bucket(group[rows], key[rows], block[rows], (lo == hi)[rows], unit(x))
                i, j = bucket.pairs(threshold)
                if not len(i):
                    continue
                index = known.setdefault(x.shape[1], Index(x.shape[1], k, tables))
                first = bucket.first_meeting(i, j, index)
                i, j = i[first], j[first]
                weight = copies[rows]
                n = np.bincount(i, weight[j], len(rows)) + np.bincount(j, weight[i], len(rows))
                of = np.flatnonzero(n)
                root = rep[rows][forest(len(rows), i, j)[of]]
                of_rows = rows[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[of_rows]), pa.array(h2[of_rows]), pa.array(n[of].astype(np.int64)), pa.array(rep[of_rows]), pa.array(root)],
                    ["h1", "h2", "n", "a", "b"])

    dealt = members.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "h1")
    return dealt.mapInArrow(run, "h1 long, h2 long, n long, a long, b long")


def _linked(classes: DataFrame, k: int, tables: range, all_tables: int, threshold: float) -> DataFrame:
    """Links of the pairs whose smallest shared key lies in these tables."""
    entries = _entries(classes, k, tables)
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / F.lit(BLOCK))
    placed = entries.join(shared, "key").select("key", "h1", blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("h1"), F.col("blocks"))
    members = placed.join(classes, "h1").withColumn("block", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                             "block", "h1", "h2", "rep", "copies", "vec")
    return _verified(members, k, all_tables, threshold)


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding).

    Rows link when the cosine of their vectors, in doubles, is at least ``threshold``; pairs are found
    with the probability the tables are made for, links below the threshold never occur. n_links counts
    the other rows a row links with, equal vectors among them; component_id is the smallest vec_id
    reachable; kept marks the rows that bear it. Null, empty and zero vectors and those with null or
    non-finite components link with nothing, nor do rows without a vec_id, whose component is null.
    Vectors of different lengths never link. Unlike vectors under one vec_id are one node of a
    component. ids are integers; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    given = only(vectors, "vec_id", "embedding").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "float" else "array<double>").alias("vec"))
    rows = materialise(_named(given).select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("h1")).alias("h1"), "h2"), "cp-rows")
    live = _named(given).where("h1 is not null and vec_id is not null")
    classes = materialise(live.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")), "cp-classes")

    stats = classes.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per vector length
    k = max((key_length(r.n, r.dim) for r in stats), default=2)
    calibrated = {padded(r.dim): r.dim for r in stats}
    tables = max((tables_needed(dim, k, threshold) for dim in calibrated.values()), default=1)
    links = None
    for a in range(0, tables, TABLES_AT_ONCE):
        some = range(a, min(a + TABLES_AT_ONCE, tables))
        part = settled(spark, lambda some=some: _linked(classes, k, some, tables, threshold), "cp-links")
        links = part if links is None else links.unionByName(part)

    briefs = classes.drop("vec")
    twice = rows.where("h1 is not null").join(briefs, ["h1", "h2"]).groupBy("vec_id").agg(
        F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    edges = links.where("a <> b").select("a", "b").union(twice).distinct()
    roots = settled(spark, lambda: components(edges, "cp-joined"), "cp-roots")
    counts = links.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    named = briefs.join(counts, ["h1", "h2"], "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("root"))
    component = F.coalesce("root", "vec_id")
    return rows.join(named, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
