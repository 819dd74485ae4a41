"""Boosted trees for several classes: histogram splits under the softmax loss, with early stopping.

Features become at most ``bins`` codes once. A level of all class trees of a round is one job: tasks sum
gradients and hessians by (class, node, feature, code) and emit each sum once, so what meets in the driver
is bounded by the settings, never by the rows. Held-out log loss is summed in the same pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.session import materialise

KEEP_ROUNDS = 10  # rounds after which the rows' margins are written anew
LOSS = -1  # class number under which the held-out loss travels


@dataclass
class Settings:
    rounds: int = 50
    depth: int = 4
    step: float = 0.3
    bins: int = 32  # 255 at most
    ridge: float = 1.0
    gamma: float = 0.0  # least gain of a split
    min_child_weight: float = 1.0  # least hessian sum of a leaf
    most: float = 4.0  # largest value of a leaf before the step: a class not met so far has next to no hessian
    row_share: float = 1.0  # rows a round learns from
    feature_share: float = 1.0  # features a tree may split on
    patience: int = 5  # rounds without a better held-out loss before the end
    seed: int = 42


@dataclass
class Boosted:
    """Class trees as arrays: node ``i`` has the children ``2 i + 1`` and ``2 i + 2``."""

    features: list[str]
    edges: list[list[float]]
    classes: int
    start: list[float]
    trees: list[list[dict]] = field(default_factory=list)  # round -> class -> feature, code, value of the nodes

    def codes(self, frame: pd.DataFrame) -> np.ndarray:
        """(row, feature) codes; missing values have the code behind all others."""
        out = np.empty((len(frame), len(self.features)), np.uint8)
        for j, (name, edges) in enumerate(zip(self.features, self.edges)):
            x = frame[name].to_numpy(dtype=float)
            out[:, j] = np.where(np.isnan(x), len(edges) + 1, np.searchsorted(edges, x, side="right"))
        return out

    def margins(self, codes: np.ndarray, begin: int = 0, base: np.ndarray | None = None) -> np.ndarray:
        total = np.tile(np.array(self.start), (len(codes), 1)) if base is None else base.copy()
        for trees in self.trees[begin:]:
            for k, tree in enumerate(trees):
                total[:, k] += np.array(tree["value"])[leaves(tree, codes)]
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` (vector) and ``prediction``; ties go to the smaller class."""
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                p = softmax(self.margins(self.codes(frame)))
                yield frame.assign(_p=list(p), prediction=p.argmax(axis=1).astype(float))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        scored = df.mapInPandas(run, f"{schema}, _p array<double>, prediction double")
        return scored.withColumn("probability", array_to_vector("_p")).drop("_p")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "Boosted":
        return cls(**json.loads(text))


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def leaves(tree: dict, codes: np.ndarray) -> np.ndarray:
    """Node of every row: the leaf, or the open node of the last level grown so far."""
    feature, code = np.array(tree["feature"]), np.array(tree["code"])
    node = np.zeros(len(codes), np.int64)
    rows = np.arange(len(codes))
    for _ in range(len(feature).bit_length()):
        inner = feature[node] >= 0
        right = codes[rows, np.maximum(feature[node], 0)] > code[node]
        node = np.where(inner, 2 * node + 1 + right, node)
    return node


def fit_boosted(train: DataFrame, features: list[str], label: str, classes: int, settings: Settings | None = None,
                grown: Boosted | None = None) -> Boosted:
    """Fit on rows with integer labels 0 .. classes - 1; a hashed fifth of them is held out to stop early.

    With ``grown``, an earlier model of the same features and classes, trees learnt from these rows are
    added to its own, which stay as they are: a warm start on a new batch.
    """
    s, spark = settings or Settings(), train.sparkSession
    probabilities = [i / s.bins for i in range(1, s.bins)]
    numbers = train.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("int").alias("_label"))
    if grown is None:
        edges = [sorted(set(e)) for e in numbers.approxQuantile(features, probabilities, 1.0 / (4 * s.bins))]
        counts = {r["_label"]: r["n"] for r in numbers.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
        share = np.array([counts.get(k, 0) + 1.0 for k in range(classes)])
        model = Boosted(features, edges, classes, np.log(share / share.sum()).tolist())
    elif (grown.features, grown.classes) != (features, classes):
        raise ValueError("a model grows on the features and classes it was fitted with")
    else:
        model = Boosted(features, grown.edges, classes, grown.start, list(grown.trees))
    draw = F.xxhash64(F.lit(s.seed), "_label", *features)

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            codes = model.codes(frame)
            yield pd.DataFrame({"label": frame["_label"], "draw": frame["_draw"], "codes": [r.tobytes() for r in codes],
                                "margins": model.margins(codes).tolist()})

    rows = materialise(numbers.withColumn("_draw", draw).mapInPandas(
        coded, "label int, draw long, codes binary, margins array<double>"), "boosting")
    earlier = written = len(model.trees)
    best, best_loss = 0, np.inf
    for turn in range(s.rounds + 1):
        columns = [np.random.default_rng([s.seed, earlier + turn, k]).permutation(len(features))[:max(1, round(s.feature_share * len(features)))] for k in range(classes)]
        size = 2 ** (s.depth + 1) - 1
        trees = [{"feature": [-1] * size, "code": [0] * size, "value": [0.0] * size} for _ in range(classes)]
        for level in range(s.depth + 1):
            sums = _histograms(rows, model, trees, level, turn, written, s)
            lost, n_held = sums.pop((LOSS, 0), (0.0, 0.0))
            if level == 0:
                loss = float(lost / max(n_held, 1))
                if not n_held or loss < best_loss - 1e-9:
                    best, best_loss = turn, loss
                if turn == s.rounds or turn - best >= s.patience:
                    model.trees = model.trees[:earlier + best]
                    return model
            if not _grow(trees, sums, columns, level, model, s):
                break
        model.trees.append(trees)
        if len(model.trees) - written >= KEEP_ROUNDS:
            rows, written = _rewritten(rows, model, written), len(model.trees)
    return model


def _rewritten(rows: DataFrame, model: Boosted, written: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            codes, base = _arrays(frame, len(model.features))
            yield frame.assign(margins=model.margins(codes, written, base).tolist())

    return materialise(rows.mapInPandas(run, rows.schema), "boosting")


def _arrays(frame: pd.DataFrame, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(frame["codes"]), np.uint8).reshape(len(frame), n_features)
    return codes, np.vstack(frame["margins"].to_numpy()).astype(float)


def _histograms(rows: DataFrame, model: Boosted, trees: list[dict], level: int, turn: int, written: int, s: Settings) -> dict:
    """(class, node) -> (gradient, hessian) by feature and code of the open nodes; (LOSS, 0) -> (sum, rows)."""
    width, n_features = s.bins + 2, len(model.features)
    first, n_nodes = 2 ** level - 1, 2 ** level

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, model.classes, n_nodes, n_features * width))
        loss = np.zeros(2)
        for frame in frames:
            if not len(frame):
                continue
            codes, base = _arrays(frame, n_features)
            p, label, draw = softmax(model.margins(codes, written, base)), frame["label"].to_numpy(), frame["draw"].to_numpy()
            held = draw % 5 == 0
            loss += -np.log(np.maximum(p[held, label[held]], 1e-15)).sum(), held.sum()
            chance = (draw.astype(np.uint64) * np.uint64(2 * turn + 0x9E3779B97F4A7C15)) >> np.uint64(11)
            used = ~held & (chance.astype(float) / 2 ** 53 < s.row_share)
            codes, p, label = codes[used], p[used], label[used]
            cell = codes + np.arange(n_features) * width
            for k in range(model.classes):
                node = leaves(trees[k], codes) - first
                here = (node >= 0) & (node < n_nodes)
                place = (node[here, None] * (n_features * width) + cell[here]).ravel()
                gradient, hessian = p[here, k] - (label[here] == k), p[here, k] * (1 - p[here, k])
                for i, x in enumerate((gradient, hessian)):
                    total[i, k] += np.bincount(place, np.repeat(x, n_features), n_nodes * n_features * width).reshape(n_nodes, -1)
        k, node, at = np.nonzero(total[1])
        yield pd.DataFrame({"k": np.append(k, LOSS), "node": np.append(node, 0), "at": np.append(at, 0),
                            "g": np.append(total[0][k, node, at], loss[0]), "h": np.append(total[1][k, node, at], loss[1])})

    sums = rows.mapInPandas(run, "k int, node int, at int, g double, h double").groupBy("k", "node", "at").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()  # at most classes * 2^level * features * codes rows
    found = {}
    for (k, node), part in sums.groupby(["k", "node"]):
        if k == LOSS:
            found[LOSS, 0] = part["g"].iloc[0], part["h"].iloc[0]
            continue
        g, h = np.zeros((2, n_features * width))
        g[part["at"]], h[part["at"]] = part["g"], part["h"]
        found[int(k), int(node) + first] = g.reshape(n_features, width), h.reshape(n_features, width)
    return found


def _grow(trees: list[dict], sums: dict, columns: list[np.ndarray], level: int, model: Boosted, s: Settings) -> bool:
    """Set the values of the open nodes and split those worth it; whether any was split."""
    split = False
    for (k, node), (g, h) in sorted(sums.items()):
        whole_g, whole_h = g[0].sum(), h[0].sum()
        trees[k]["value"][node] = float(s.step * np.clip(-whole_g / (whole_h + s.ridge), -s.most, s.most))
        if level == s.depth:
            continue
        left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
        right_g, right_h = whole_g - left_g, whole_h - left_h
        score = lambda a, b: a ** 2 / (b + s.ridge)
        gain = (score(left_g, left_h) + score(right_g, right_h) - score(whole_g, whole_h)) / 2
        fits = (np.minimum(left_h, right_h) >= s.min_child_weight) & np.isin(np.arange(len(g)), columns[k])[:, None]
        gain = np.where(fits, gain, -np.inf)
        feature, code = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[feature, code] > max(s.gamma, 1e-9):
            trees[k]["feature"][node], trees[k]["code"][node] = int(feature), int(code)
            split = True
    return split
