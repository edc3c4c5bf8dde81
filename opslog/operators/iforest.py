"""Isolation forest: fit and score as Spark jobs."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from opslog.operators.ranking import quantiles
from opslog.session import by_key

# Settings of the forest.
TREES = 250
FEATURE_SHARE = 0.85
SEED = 42
SAMPLE = 256
CONTAMINATION = 0.025

NODES = "tree int, node int, feature int, threshold double, left int, right int, size int"
EULER_GAMMA = 0.5772156649015329
CONSTANT = 1e-7  # a feature that varies less is not split on
OVERSAMPLE = 2.0
#: Path lengths add up as integers of this part, so that equal paths give equal scores in any order.
UNITS = 10 ** 12
DRAW_DIGITS = 15
CELLS = 4_000_000


def path_norm(n):
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=np.float64)
    big = np.maximum(n, 3)
    full = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, full))


def dense(indices, values, columns: np.ndarray) -> np.ndarray:
    """Rows of sparse vectors as a matrix over the sorted ``columns``."""
    out = np.zeros((len(indices), len(columns)))
    lengths = np.fromiter((len(i) for i in indices), dtype=np.int64, count=len(indices))
    if lengths.sum() == 0 or len(columns) == 0:
        return out
    flat_i = np.concatenate([np.asarray(i, dtype=np.int64) for i in indices])
    flat_v = np.concatenate([np.asarray(v, dtype=np.float64) for v in values])
    row = np.repeat(np.arange(len(indices)), lengths)
    at = np.minimum(np.searchsorted(columns, flat_i), len(columns) - 1)
    hit = columns[at] == flat_i
    out[row[hit], at[hit]] = flat_v[hit]
    return out


def draw(*parts) -> str:
    """A draw that depends on its parts alone, as hexadecimal digits: the same in every engine."""
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def grow_tree(matrix: np.ndarray, features: np.ndarray, seed: int, tree: int, max_depth: int) -> list[tuple]:
    """Random splits until a node holds one point, equal points, or is deep enough.

    The matrix holds values of single precision, and features that vary by less than that
    resolves count as constant, so that the order in which Spark added up a norm
    never decides a split. A node's draws depend on the seed, the tree and its place: the root is 1, the children of n are 2n and 2n + 1.
    """
    nodes: list[tuple] = []
    todo = [(np.arange(len(matrix)), 0, -1, "", 1)]
    links: dict[int, dict[str, int]] = {}
    while todo:
        rows, depth, parent, side, place = todo.pop()
        node = len(nodes)
        if parent >= 0:
            links[parent][side] = node
        part = matrix[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        open_cols = np.flatnonzero(high - low > CONSTANT)
        if depth >= max_depth or len(rows) <= 1 or len(open_cols) == 0:
            nodes.append((-1, 0.0, len(rows)))
            continue
        col = min(open_cols, key=lambda c: draw(seed, tree, place, features[c]))
        low, high = float(low[col]), float(high[col])
        cut = low + int(draw(seed, tree, place)[:13], 16) / 2 ** 52 * (high - low)
        if cut >= high:  # rounding put the cut on the maximum
            cut = low
        goes_left = part[:, col] <= cut
        nodes.append((int(features[col]), cut, len(rows)))
        links[node] = {}
        todo.append((rows[~goes_left], depth + 1, node, "right", 2 * place + 1))
        todo.append((rows[goes_left], depth + 1, node, "left", 2 * place))
    return [
        (i, f, t, links.get(i, {}).get("left", -1), links.get(i, {}).get("right", -1), size)
        for i, (f, t, size) in enumerate(nodes)
    ]


def tree_samples(features: DataFrame, n_rows: int, trees: int, sample: int, seed: int) -> DataFrame:
    """For each tree, its ``sample`` rows with the smallest hash.

    A row is passed on only for trees where its hash is small, so about twice
    the wanted rows reach the shuffle, however large the input is.
    """
    share = min(1.0, OVERSAMPLE * sample / max(n_rows, 1))
    limit = format(min(int(share * 16 ** DRAW_DIGITS), 16 ** DRAW_DIGITS - 1), f"0{DRAW_DIGITS}x")
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(t.alias("tree"), F.substring(
            F.md5(F.concat_ws(":", F.lit(str(seed)), t.cast("string"), F.col("block_id"))), 1, DRAW_DIGITS).alias("draw")),
    )
    picked = features.select(
        "*", F.inline(F.filter(draws, lambda d: d["draw"] <= F.lit(limit)))
    )
    order = W.partitionBy("tree").orderBy("draw", "block_id")
    return by_key(picked, "tree").withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= sample).drop("_rn", "draw")


def iforest_fit(features: DataFrame, n_features: int, n_rows: int | None = None, trees: int = TREES,
                feature_share: float = FEATURE_SHARE, seed: int = SEED, sample: int = SAMPLE) -> DataFrame:
    """Node table of the forest. Each task grows one tree from at most ``sample`` rows.

    A tree may use its share of all features. Features that no row of the
    sample sets are constant and could never be split on, so only the others
    are turned into columns.
    """
    n_rows = features.count() if n_rows is None else n_rows
    psi = min(sample, n_rows)
    depth = max(1, math.ceil(math.log2(max(psi, 2))))
    width = max(1, int(feature_share * n_features))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("block_id")
        allowed = np.array(sorted(range(n_features), key=lambda f: (draw(seed, tree, "f", f), f))[:width])
        present = np.unique(np.concatenate([np.asarray(i, dtype=np.int64) for i in pdf["indices"]]))
        columns = np.intersect1d(allowed, present)
        if len(columns) == 0:
            nodes = [(0, -1, 0.0, -1, -1, len(pdf))]
        else:
            matrix = dense(pdf["indices"], pdf["values"], columns).astype(np.float32).astype(np.float64)
            nodes = grow_tree(matrix, columns, seed, tree, depth)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size"])
        out.insert(0, "tree", tree)
        return out

    picked = tree_samples(features, n_rows, trees, psi, seed)
    return picked.groupBy("tree").applyInPandas(build, NODES).withColumn("psi", F.lit(psi))


@dataclass(frozen=True)
class Forest:
    """The node table as arrays, for use inside tasks."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    roots: np.ndarray
    columns: np.ndarray
    psi: int

    @staticmethod
    def load(nodes: DataFrame) -> Forest:
        """At most ``trees * (2 * psi - 1)`` rows, whatever data the forest was fitted on."""
        pdf = nodes.toPandas().sort_values(["tree", "node"], ignore_index=True)
        roots = np.flatnonzero(pdf["node"].to_numpy() == 0)
        base = roots[np.unique(pdf["tree"], return_inverse=True)[1]]
        feature = pdf["feature"].to_numpy()
        columns = np.unique(feature[feature >= 0])
        leaf = feature < 0
        place = np.arange(len(pdf))
        return Forest(
            np.where(leaf, 0, np.searchsorted(columns, feature)), pdf["threshold"].to_numpy(),
            np.where(leaf, place, base + pdf["left"].to_numpy()),
            np.where(leaf, place, base + pdf["right"].to_numpy()),
            np.where(leaf, pdf["size"].to_numpy(), 0), roots, columns, int(pdf["psi"].iloc[0]),
        )

    def _steps(self, rows: int):
        step = max(1, CELLS // max(len(self.columns), len(self.roots), 1))
        return [slice(start, start + step) for start in range(0, rows, step)]

    def score(self, indices, values) -> np.ndarray:
        """Score of each sparse row: -2^(-mean path / c(psi)); lower is more anomalous."""
        parts = [self._walk(dense(indices[s], values[s], self.columns)) for s in self._steps(len(indices))]
        return np.concatenate([np.empty(0), *parts])

    def score_matrix(self, matrix: np.ndarray, squares: np.ndarray | None = None) -> np.ndarray:
        """Score of each row of a matrix over the forest's columns; the rows' squared length does not matter."""
        return np.concatenate([np.empty(0), *[self._walk(matrix[s]) for s in self._steps(len(matrix))]])

    def _walk(self, matrix: np.ndarray) -> np.ndarray:
        norm = float(path_norm(self.psi)) or 1.0
        matrix = matrix.astype(np.float32)
        if matrix.shape[1] == 0:
            matrix = np.zeros((len(matrix), 1))
        at = np.broadcast_to(self.roots, (len(matrix), len(self.roots))).copy()
        steps = np.zeros(at.shape, np.int64)
        rows = np.arange(len(matrix))[:, None]
        while True:
            inner = self.size[at] == 0
            if not inner.any():
                break
            low = matrix[rows, self.feature[at]] <= self.threshold[at]
            steps += inner
            at = np.where(low, self.left[at], self.right[at])
        total = (steps * UNITS + np.rint(path_norm(self.size[at]) * UNITS).astype(np.int64)).sum(axis=1)
        return -np.exp2(-(total / (float(UNITS) * at.shape[1])) / norm)


def score_column(spark, forest: Forest):
    """A pandas UDF (indices, values) -> score; equal rows of a batch are walked once."""
    shared = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(indices: pd.Series, values: pd.Series) -> pd.Series:
        keys = [np.asarray(i).tobytes() + b"|" + np.asarray(v).tobytes() for i, v in zip(indices, values)]
        codes, firsts = pd.factorize(pd.Series(keys, dtype=object))
        place = pd.Series(np.arange(len(codes))).groupby(codes).first().to_numpy()
        distinct = shared.value.score(indices.to_numpy()[place], values.to_numpy()[place])
        return pd.Series(distinct[codes])

    return score


def iforest_score(features: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add the raw score of each feature row."""
    score = score_column(features.sparkSession, Forest.load(nodes))
    return features.withColumn("score_sample", score("indices", "values"))


def iforest_offsets(scored: DataFrame, contaminations: list[float]) -> list[float]:
    """Score thresholds: the contamination quantiles of the training scores."""
    return quantiles(scored, "score_sample", "block_id", contaminations)


def predict(scored: DataFrame, offset: float | Column) -> DataFrame:
    """Decision score and flag; strictly below the offset is an anomaly."""
    offset = F.lit(offset) if isinstance(offset, float) else offset
    return scored.withColumn("score", F.col("score_sample") - offset).withColumn(
        "is_anomaly", F.col("score") < 0
    )
