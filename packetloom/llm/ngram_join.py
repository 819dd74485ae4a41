"""N-gram Jaccard join: universe partition, one-deletion neighbourhoods, exact verification.

Two sets whose Jaccard similarity reaches ``num / den`` differ in at most ``H`` shingles. A size band
hashes every shingle into ``m = H_max + 1`` segments; if each segment ``i`` were off by at least
``v_i`` and the ``v_i`` sum to ``H + 1``, the sets would differ too much, so some segment is off by
less than its ``v_i``. The larger document of a pair probes, the smaller is indexed:

* ``v = 1``: the probing segment equals the indexed one;
* ``v = 2``: equal up to one shingle, found through one-deletion keys of both sides;
* ``v = 0``: not probed. Segments of none or one shingle are shared by many unrelated documents and
  cost most; they get 0, paid for by slack of the band or by a 2 elsewhere.

Documents with the same set are one class. Inside a bucket only the star to one hub is compared, not
all pairs; the hub is the member that shares most bucket places with others, so that a group of near
copies gathers round its centre. What the stars leave open (buckets with several components) is
compared pair by pair only where the parity sketches allow a link: shingles fall into 512 cells, and
every cell whose parity differs holds at least one shingle that only one of the two has. Sets with more
shingles than cells carry a second sketch as wide as they are, and only pairs that pass it fetch their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.components import components
from packetloom.llm.tables import only
from packetloom.llm.words import mix, shingle_sets, slices
from packetloom.session import materialise, settled

_SALT = np.uint64(0xA24BAED4963EE407)
SKETCH = 8


class Scheme:
    """Size bands, segment counts and the keys of one set, for a threshold of ``num / den``."""

    def __init__(self, num: int, den: int):
        if not 0 < num < den:
            raise ValueError("the threshold must lie between 0 and 1")
        self.num, self.den = num, den
        self.starts = [-(-(den + num) // (2 * (den - num)))]
        self.ratio = max(1.5, den / num + 0.01)

    def most(self, n: int) -> int:
        """Largest difference between a set of ``n`` and one no larger that still links."""
        return 2 * n * (self.den - self.num) // (self.den + self.num)

    def band(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * self.ratio)))
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def segments(self, band: int) -> int:
        self.band(self.starts[band])
        return self.most(self.starts[band + 1] - 1) + 1

    def keys(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket keys of a set and which of them it probes with."""
        n = len(values)
        own = self.band(n)
        parts = [self._of(values, own, True)] if own >= 0 else []
        if n and self.den * n >= self.num * self.starts[own + 1]:
            parts.append(self._of(values, own + 1, False))
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _of(self, values: np.ndarray, band: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
        m = self.segments(band)
        seed = mix(np.array([band + 1], np.uint64))[0]
        scrambled = mix(values ^ seed)
        segment = ((scrambled >> np.uint64(16)) % np.uint64(m)).astype(np.int64)
        counts = np.bincount(segment, minlength=m)
        order = np.argsort(segment, kind="stable")
        sums = np.zeros(m, np.uint64)
        full = np.flatnonzero(counts)
        sums[full] = np.add.reduceat(scrambled[order], (np.cumsum(counts) - counts)[full])
        tag = mix(np.arange(m, dtype=np.uint64) * _SALT + seed)
        spare = range(min(m, 1 + m // 256))  # segments that are indexed with one-deletion keys
        worth = np.full(m, int(own))
        if own:
            ranked = np.argsort(counts, kind="stable").tolist()  # costliest first
            slack = m - self.most(len(values)) - 1
            worth[ranked[:slack]] = 0
            rest = ranked[slack:]
            for j in spare:
                if rest and counts[rest[0]] <= 1 and worth[j] == 1 and counts[j] >= 4:
                    worth[j] = 2
                    worth[rest.pop(0)] = 0
        keys, probes = [mix(sums + tag)], [worth > 0]
        for j in spare:
            members = scrambled[segment == j]
            keys.append(mix(sums[j] - members + tag[j]))
            probes.append(np.full(len(members), worth[j] == 2))
        return np.concatenate(keys), np.concatenate(probes)


def set_digest(values: np.ndarray) -> tuple[int, int]:
    a = mix(values).sum(dtype=np.uint64)
    b = mix(values ^ _SALT).sum(dtype=np.uint64)
    return int(mix(np.array([a]))[0].view(np.int64)), int(mix(np.array([b]))[0].view(np.int64))


def sketch(values: np.ndarray) -> np.ndarray:
    """Parities of the number of shingles in each of 64 * SKETCH cells, as SKETCH longs."""
    cells = mix(values + _SALT) % np.uint64(64 * SKETCH)
    return np.packbits(np.bincount(cells.astype(np.int64), minlength=64 * SKETCH) & 1).view(np.int64)


def fine_sketch(values: np.ndarray) -> np.ndarray | None:
    """The sketch of a set too large for SKETCH longs, with a power of two of cells, at least its size.

    Sketches of different widths meet by folding: the halves of the wider one are added (xor).
    """
    if len(values) <= 64 * SKETCH:
        return None
    width = 64 << int(np.ceil(np.log2(len(values) / 64)))
    cells = mix(values + _SALT) % np.uint64(width)
    return np.packbits(np.bincount(cells.astype(np.int64), minlength=width) & 1).view(np.int64)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _digests(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            sets = [(len(s), *set_digest(s), sketch(s), fine_sketch(s)) for s in shingle_sets(piece.column("text"), shingle)]
            n, h1, h2, cells, fine = zip(*sets)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, SKETCH * len(n) + 1, SKETCH), pa.int32()), pa.array(np.concatenate(cells)))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), cells,
                 pa.array(fine, pa.list_(pa.int64()))],
                ["doc_id", "n", "h1", "h2", "cells", "fine"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, cells array<long>, fine array<long>")


def _signatures(docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, seen = Scheme(num, den), set()
        for piece in slices(batches):
            keys, probes, owners = [], [], []
            for values in shingle_sets(piece.column("text"), shingle):
                name = set_digest(values)
                if not len(values) or name in seen:
                    continue
                seen.add(name)  # copies met by the same task need no second set of keys
                key, probe = scheme.keys(values)
                keys.append(key)
                probes.append(probe)
                owners.append(np.full(len(key), name[0], np.int64))
            if len(seen) > 1_000_000:
                seen.clear()
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(np.concatenate(keys))), pa.array(np.concatenate(owners)), pa.array(np.concatenate(probes))],
                    ["key", "h1", "probe"])

    return docs.mapInArrow(run, "key long, h1 long, probe boolean")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            sets = list(shingle_sets(piece.column("text"), shingle))
            h1, h2 = zip(*[set_digest(s) for s in sets])
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(np.concatenate(sets))))
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), items], ["h1", "h2", "items"])

    return docs.mapInArrow(run, "h1 long, h2 long, items array<long>")


def _buckets(texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(key, h1, probe, hub) of all buckets with a probing and another member."""
    by_key = Window.partitionBy("key")
    keyed = _signatures(texts, shingle, num, den)
    shared = materialise(
        keyed.select("*", F.max("probe").over(by_key).alias("probed"), F.count(F.lit(1)).over(by_key).alias("members"),
                     F.min("h1").over(by_key).alias("lo"), F.max("h1").over(by_key).alias("hi"))
        .where("probed and lo < hi").select("key", "h1", "probe", "members"), "jaccard-shared")
    places = shared.groupBy("h1").agg(F.sum("members").alias("places"))
    ranked = F.when(F.col("probe"), F.struct("places", "h1"))
    return shared.join(places, "h1").select("key", "h1", "probe", F.max(ranked).over(by_key)["h1"].alias("hub"))


def _possible(num: int, den: int) -> str:
    """Condition on sizes and sketches of two sets (l_, r_) that every link meets."""
    differ = " + ".join(f"bit_count(l_cells[{k}] ^ r_cells[{k}])" for k in range(SKETCH))
    return f"{den} * l_n >= {num} * r_n and {den} * r_n >= {num} * l_n and ({differ}) * {den + num} <= (l_n + r_n) * {den - num}"


def _folded(name: str, width: str) -> str:
    """Word ``i`` of a sketch folded to ``width`` words."""
    return f"aggregate(sequence(i, size({name}) - 1, {width}), 0L, (x, j) -> x ^ {name}[j])"


def _narrowed(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) whose fine sketches allow a link; pairs with a set too small for one stay."""
    large = classes.where("fine is not null").groupBy("h1").agg(F.first("n").alias("n"), F.first("fine").alias("fine"))
    left = large.select(F.col("h1").alias("x"), F.col("n").alias("l_n"), F.col("fine").alias("l"))
    right = large.select(F.col("h1").alias("y"), F.col("n").alias("r_n"), F.col("fine").alias("r"))
    both = pairs.join(right, "y", "left").join(left, "x", "left")
    words = "least(size(l), size(r))"
    differ = f"aggregate(sequence(0, {words} - 1), 0, (s, i) -> s + bit_count({_folded('l', words)} ^ {_folded('r', words)}))"
    possible = F.expr(f"case when l is null or r is null then true else {differ} * {den + num} <= (l_n + r_n) * {den - num} end")
    return both.where(possible).select("x", "y")


def _links(pairs: DataFrame, texts: DataFrame, classes: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(a, b) representatives of the pairs (x, y: h1) whose sets are similar enough, exactly."""
    pairs = materialise(_narrowed(pairs, classes, num, den), "jaccard-narrowed")
    wanted = pairs.select(F.col("x").alias("h1")).union(pairs.select(F.col("y").alias("h1"))).distinct()
    needed = materialise(classes.select("h1", "h2", "rep", "n").join(wanted, "h1", "left_semi"), "jaccard-needed")
    # sorted and merged at every size: which texts are needed grows with the corpus
    picked = texts.join(needed.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    picked = materialise(picked, "jaccard-picked")  # frees the shuffled texts before their sets are dealt
    sets = materialise(
        _sets(picked, shingle).dropDuplicates(["h1", "h2"]).join(needed, ["h1", "h2"]).select("h1", "rep", "n", "items"), "jaccard-sets")
    left = sets.select(F.col("h1").alias("x"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    right = sets.select(F.col("h1").alias("y"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    both = pairs.join(right, "y").join(left, "x").select("a", "b", "na", "nb", F.size(F.array_intersect("ia", "ib")).cast("long").alias("inter"))
    return both.where(f"{den} * inter >= {num} * (na + nb - inter)").select("a", "b")


def jaccard_components(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text).

    Documents link when ``den * |A & B| >= num * |A | B|`` over their distinct word shingles; a text
    shorter than ``shingle`` words is one shingle. component_id is the smallest doc_id reachable.
    Null and empty texts have no shingles and link with nothing. Rows that share a doc_id are one
    node; rows without a doc_id keep null as component and take part in nothing. Every link between
    different texts is honoured, whatever the size of a group.
    """
    texts = only(docs, "doc_id", "text")
    rows = materialise(_digests(texts, shingle), "jaccard-digests")
    live = rows.where("doc_id is not null and n > 0")
    classes = materialise(live.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("cells").alias("cells"), F.first("fine").alias("fine")), "jaccard-classes")
    briefs = classes.groupBy("h1").agg(F.min("rep").alias("rep"), F.first("n").alias("n"), F.first("cells").alias("cells"))

    spark = docs.sparkSession
    buckets = settled(spark, lambda: _buckets(texts.where("doc_id is not null"), shingle, num, den), "jaccard-buckets")
    left = briefs.select(F.col("h1").alias("x"), F.col("n").alias("l_n"), F.col("cells").alias("l_cells"))
    right = briefs.select(F.col("h1").alias("y"), F.col("n").alias("r_n"), F.col("cells").alias("r_cells"))
    stars = buckets.where("h1 <> hub").select(F.col("hub").alias("x"), F.col("h1").alias("y")).distinct()
    stars = materialise(stars.join(right, "y").join(left, "x").where(_possible(num, den)).select("x", "y"), "jaccard-stars")
    links = settled(spark, lambda: _links(stars, texts, classes, shingle, num, den), "jaccard-links")
    twice = classes.join(live.select("doc_id", "h1", "h2"), ["h1", "h2"]).groupBy("doc_id").agg(
        F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    links = links.union(materialise(twice, "jaccard-twice"))
    roots = settled(spark, lambda: components(links, "jaccard-stars-joined"), "jaccard-roots")

    more = settled(spark, lambda: _open_pairs(buckets, briefs, roots, num, den), "jaccard-open")
    extra = settled(spark, lambda: _links(more, texts, classes, shingle, num, den), "jaccard-extra")
    if extra.limit(1).count():
        roots = settled(spark, lambda: components(links.union(extra), "jaccard-all"), "jaccard-roots")

    named = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", F.coalesce("component", "rep").alias("root"))
    return rows.join(named, ["h1", "h2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def _open_pairs(buckets: DataFrame, briefs: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs in different components that share a bucket and may still link."""
    known = briefs.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "n", "cells", F.coalesce("component", "rep").alias("root"))
    by_key = Window.partitionBy("key")
    rows = buckets.where("h1 <> hub").join(known.select("h1", "root"), "h1")
    rows = rows.select("*", F.min("root").over(by_key).alias("lo"), F.max("root").over(by_key).alias("hi"),
                       F.max("probe").over(by_key).alias("probed")).where("lo < hi and probed").select("key", "h1", "probe", "root")
    rows = materialise(rows.dropDuplicates(["key", "h1"]).join(known.drop("root"), "h1"), "jaccard-rows")
    left = rows.select("key", *[F.col(c).alias(f"l_{c}") for c in ("h1", "probe", "n", "root", "cells")])
    right = rows.select("key", *[F.col(c).alias(f"r_{c}") for c in ("h1", "probe", "n", "root", "cells")])
    return left.join(right, "key").where(
        f"l_h1 < r_h1 and l_root <> r_root and (l_probe or r_probe) and {_possible(num, den)}"
    ).select(F.col("l_h1").alias("x"), F.col("r_h1").alias("y")).distinct()
