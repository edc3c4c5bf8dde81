"""One-class SVM, linear and rbf, solved by cutting planes to a stated duality gap.

The problem is to minimise ``1/2 |w|^2 - rho + sum(max(0, rho - w.x)) / (nu n)``. One pass over the rows at a
point (w, rho) yields how many rows lie below rho and the sum of their vectors. That is a plane below the
loss, and at the same time a vertex of the dual: rows of equal weight. The driver keeps the few vertices in
use and finds their best mixture, whose sum is the next w. The mixture is feasible in the dual, so the
difference to the best primal value is a duality gap, and the solver ends when that is small. No
state per row is kept, so a lost executor costs one task of one pass.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F

from opslog.operators.iforest import dense
from opslog.session import stage

# The grid of the one-class models.
NUS = (0.015, 0.02, 0.025, 0.03)
KERNELS = ("rbf", "linear")

#: The solver ends at this gap, relative to |w|^2, or to a small part of the mean square of the rows if w vanishes.
GAP = 1e-6
VANISHED = 1e-4
#: Passes without a better gap after which rounding is taken to be the limit.
STALLED = 40
#: Mixtures in a row that a vertex must be left out of before it is dropped.
UNUSED = 20
#: Rows that the rbf kernel is expressed in; with no more different rows than that it is exact.
LANDMARKS = 256
BELOW, LOSS = -1, -2
CELLS = 2_000_000

MACHINE = "kernel string, nu double, gamma double, rho double, slack double, gap double, landmark int, idx int, value double"


def flat(indices, values) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of every stored cell."""
    lengths = np.fromiter((len(i) for i in indices), dtype=np.int64, count=len(indices))
    if not lengths.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return (np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.asarray(i, dtype=np.int64) for i in indices]),
            np.concatenate([np.asarray(v, dtype=np.float64) for v in values]))


def looked_up(columns: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of the wanted columns, 0 for others; ``columns`` are sorted."""
    if not len(columns):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(columns, wanted), len(columns) - 1)
    return np.where(columns[at] == wanted, values[at], 0.0)


@dataclass(frozen=True)
class Landmarks:
    """Rows that stand for all others in the rbf kernel."""

    columns: np.ndarray
    rows: np.ndarray
    gamma: float

    def kernel(self, cells: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """Kernel values of rows, given over ``columns`` with their squared length, and the landmarks."""
        far = squares[:, None] + (self.rows ** 2).sum(axis=1) - 2.0 * cells @ self.rows.T
        return np.exp(-self.gamma * np.maximum(far, 0.0))

    def root(self) -> np.ndarray:
        """Turns kernel values into vectors whose products are the kernel's."""
        size, turn = np.linalg.eigh(self.kernel(self.rows, (self.rows ** 2).sum(axis=1)))
        good = size > 1e-10 * max(size.max(), 1e-300)
        return turn[:, good] / np.sqrt(size[good])


@dataclass(frozen=True)
class Machine:
    """A fitted machine. A row is an outlier if its margin is below ``offset``.

    ``weights`` belong to ``columns`` in a linear machine, to the landmarks in an rbf one.
    """

    kernel: str
    nu: float
    gamma: float
    rho: float
    slack: float
    gap: float
    columns: np.ndarray
    weights: np.ndarray
    landmarks: Landmarks | None = None

    @property
    def offset(self) -> float:
        """Rows on the margin differ from rho by no more than the certified error, the slack."""
        return self.rho - self.slack

    def score_matrix(self, matrix: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """Margins of rows, given over ``columns`` with their squared length."""
        if self.landmarks is None:
            return matrix @ self.weights
        step = max(1, CELLS // max(len(self.weights), 1))
        parts = [self.landmarks.kernel(matrix[i:i + step], squares[i:i + step]) @ self.weights for i in range(0, len(matrix), step)]
        return np.concatenate([np.empty(0), *parts])

    def margins(self, indices, values) -> np.ndarray:
        """Margins of sparse rows."""
        row, column, value = flat(indices, values)
        if self.landmarks is None:
            return np.bincount(row, weights=value * looked_up(self.columns, self.weights, column), minlength=len(indices))
        squares = np.bincount(row, weights=value * value, minlength=len(indices))
        return self.score_matrix(dense(indices, values, self.columns), squares)

    def rows(self) -> pd.DataFrame:
        """The machine as rows of ``MACHINE``: weights, and of an rbf machine the cells of its landmarks."""
        if self.landmarks is None:
            cells = [(-1, int(c), float(w)) for c, w in zip(self.columns, self.weights)] or [(-1, -1, 0.0)]
        else:
            cells = [(i, -1, float(w)) for i, w in enumerate(self.weights)]
            at = np.nonzero(self.landmarks.rows)
            cells += [(int(i), int(self.columns[c]), float(self.landmarks.rows[i, c])) for i, c in zip(*at)]
        head = (self.kernel, self.nu, self.gamma, self.rho, self.slack, self.gap)
        return pd.DataFrame([(*head, *c) for c in cells], columns=[x.split()[0] for x in MACHINE.split(", ")])

    @staticmethod
    def load(stored: DataFrame) -> Machine:
        """Read back ``rows``: as many as the machine has weights, or cells in its at most ``LANDMARKS`` landmarks."""
        pdf = stored.toPandas()
        head = pdf.iloc[0]
        fixed = [str(head["kernel"]), *(float(head[c]) for c in ("nu", "gamma", "rho", "slack", "gap"))]
        if head["kernel"] == "linear":
            own = pdf[pdf["idx"] >= 0].sort_values("idx")
            return Machine(*fixed, own["idx"].to_numpy(np.int64), own["value"].to_numpy())
        weights = pdf[pdf["idx"] < 0].sort_values("landmark")["value"].to_numpy()
        cells = pdf[pdf["idx"] >= 0]
        columns, at = np.unique(cells["idx"].to_numpy(np.int64), return_inverse=True)
        rows = np.zeros((len(weights), len(columns)))
        rows[cells["landmark"].to_numpy(), at] = cells["value"].to_numpy()
        return Machine(*fixed, columns, weights, Landmarks(columns, rows, fixed[2]))


def best_mixture(gram: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """``b >= 0`` with ``sum(b) = 1`` and ``share.b = 1`` that makes ``b.gram.b`` least, and the multiplier of the latter.

    A primal-dual interior point method with Mehrotra's corrector.
    """
    n = len(gram)
    scale = max(np.trace(gram) / n, 1e-300)
    gram, rule, due = gram / scale, np.vstack([np.ones(n), share]), np.ones(2)
    b, z, y = np.full(n, 1.0 / n), np.full(n, 1.0), np.zeros(2)

    def reach(x, dx):
        down = dx < 0
        return min(1.0, float((-x[down] / dx[down]).min())) if down.any() else 1.0

    for _ in range(80):
        dual, primal, mean = gram @ b - rule.T @ y - z, rule @ b - due, b @ z / n
        if mean < 1e-14 * max(b @ gram @ b, 1e-12) and np.abs(primal).max() < 1e-11:
            break
        factor = np.linalg.inv(gram + np.diag(z / b + 1e-14))

        def step(target, bend):
            wanted = b * z - target + bend
            free, moved = factor @ (-dual - wanted / b), factor @ rule.T
            dy = np.linalg.lstsq(rule @ moved, -primal - rule @ free, rcond=None)[0]
            db = free + moved @ dy
            return db, dy, -(wanted + z * db) / b

        db, _, dz = step(0.0, 0.0)
        after = (b + reach(b, db) * db) @ (z + reach(z, dz) * dz) / n
        db, dy, dz = step(mean * (after / mean) ** 3, db * dz)
        if not (np.isfinite(db).all() and np.isfinite(dz).all()):
            break
        b, y, z = b + 0.995 * reach(b, db) * db, y + 0.995 * reach(z, dz) * dy, z + 0.995 * reach(z, dz) * dz
    return b, float(y[1]) * scale


@dataclass
class Bundle:
    """The vertices in use for one setting, as sparse vectors, and the best point so far."""

    kernel: str
    nu: float
    cap: float  # the greatest weight of a row
    parts: list = field(default_factory=list)
    share: np.ndarray = field(default_factory=lambda: np.empty(0))
    unused: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # mixtures in a row without it
    gram: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    best: tuple = (math.inf, None, 0.0)  # value, w, rho
    gap: float = math.inf
    waited: int = 0
    done: bool = False

    def add(self, columns: np.ndarray, values: np.ndarray, below: float) -> None:
        """The sum of the rows below rho, which is a vertex up to its share of the dual's weight."""
        values = values * self.cap
        products = np.array([v @ looked_up(columns, values, c) for c, v in self.parts])
        n = len(self.parts)
        gram = np.empty((n + 1, n + 1))
        gram[:n, :n], gram[n, :n], gram[:n, n], gram[n, n] = self.gram, products, products, values @ values
        self.parts.append((columns, values))
        self.share, self.gram, self.unused = np.append(self.share, below * self.cap), gram, np.append(self.unused, 0)

    def next(self) -> tuple[np.ndarray, np.ndarray, float, float]:
        """The mixture as columns, w and rho, and its dual value.

        Vertices that were in none of the last mixtures are dropped; the first two stay, between which rho lies.
        """
        b, rho = best_mixture(self.gram, self.share)
        dual = -0.5 * float(b @ self.gram @ b)
        used = np.flatnonzero(b > 0)
        columns, at = np.unique(np.concatenate([np.empty(0, np.int64), *(self.parts[i][0] for i in used)]), return_inverse=True)
        values = np.concatenate([np.empty(0), *(b[i] * self.parts[i][1] for i in used)])
        w = np.bincount(at, weights=values, minlength=len(columns))
        self.unused = np.where(b > 1e-9, 0, self.unused + 1)
        self.unused[:2] = 0
        kept = np.flatnonzero(self.unused <= UNUSED)
        self.parts, self.share, self.unused = [self.parts[i] for i in kept], self.share[kept], self.unused[kept]
        self.gram = self.gram[np.ix_(kept, kept)]
        return columns, w, rho, dual

    def judge(self, columns, w, rho: float, dual: float, loss: float, mean_square: float) -> None:
        """Take the loss at a point into account: sum of what the rows below rho lack."""
        square = float(w @ w)
        value = 0.5 * square - rho + self.cap * loss
        if value < self.best[0]:
            self.best = value, (columns, w), rho
        gap = max(self.best[0] - dual, 0.0)
        self.waited = 0 if gap < 0.99 * self.gap else self.waited + 1
        self.gap = min(self.gap, gap)
        self.done = self.gap <= GAP * max(square, VANISHED * mean_square) or self.waited >= STALLED


def gamma_scale(features: DataFrame, n_rows: int, n_features: int) -> float:
    """1 / (d * variance over all cells), cells that are not stored counting as 0."""
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    squares = F.aggregate("values", F.lit(0.0), lambda a, v: a + v * v)
    s, q = features.agg(F.sum(total), F.sum(squares)).first()
    cells = n_rows * n_features
    variance = q / cells - (s / cells) ** 2
    return 1.0 / (n_features * variance) if variance > 0 else 1.0


def landmarks_of(rows: DataFrame, gamma: float, landmarks: int = LANDMARKS) -> Landmarks:
    """At most ``landmarks`` different rows, those with the smallest hash."""
    chosen = rows.orderBy(F.xxhash64("indices", "values"), "indices", "values").limit(landmarks).toPandas()
    columns = np.unique(flat(chosen["indices"], chosen["values"])[1])
    return Landmarks(columns, dense(chosen["indices"], chosen["values"], columns), gamma)


def _pass(rows: DataFrame, points: dict, landmarks: Landmarks | None) -> dict:
    """For each setting: rows below rho, what they lack, and the columns and values of their sum."""
    shared = rows.sparkSession.sparkContext.broadcast((points, landmarks))

    def partial(batches):
        points, marks = shared.value
        sums = {s: ([np.array([BELOW, LOSS])], [np.zeros(2)]) for s in points}
        for pdf in batches:
            for a in range(0, len(pdf), step := max(1, CELLS // max(len(marks.rows) if marks else 1, 256))):
                part = pdf.iloc[a:a + step]
                n = part["n"].to_numpy(np.float64)
                row, column, value = flat(part["indices"], part["values"])
                if marks:
                    squares = np.bincount(row, weights=value * value, minlength=len(part))
                    kernel = marks.kernel(dense(part["indices"], part["values"], marks.columns), squares)
                for setting, (name, columns, w, rho) in points.items():
                    if name == "linear":
                        margin = np.bincount(row, weights=value * looked_up(columns, w, column), minlength=len(part))
                    else:
                        margin = kernel @ w
                    below = margin < rho
                    spots, found = sums[setting]
                    found[0] += n[below].sum(), (n[below] * (rho - margin[below])).sum() if rho < math.inf else 0.0
                    if name == "linear":
                        own = below[row]
                        spot, at = np.unique(column[own], return_inverse=True)
                        spots.append(spot)
                        found.append(np.bincount(at, weights=(value * n[row])[own], minlength=len(spot)))
                    elif below.any():
                        spots.append(np.arange(kernel.shape[1]))
                        found.append(n[below] @ kernel[below])
        for setting, (spots, found) in sums.items():
            spot, at = np.unique(np.concatenate(spots), return_inverse=True)
            yield pd.DataFrame({"setting": setting, "spot": spot, "value": np.bincount(at, weights=np.concatenate(found))})

    merged = rows.select("indices", "values", "n").mapInPandas(partial, "setting int, spot long, value double").groupBy(
        "setting", "spot").agg(F.sum("value").alias("value")).toPandas()
    shared.unpersist()
    out = {}
    for setting in points:
        own = merged[merged["setting"] == setting].sort_values("spot")
        spot, value = own["spot"].to_numpy(np.int64), own["value"].to_numpy()
        heads = {int(s): float(v) for s, v in zip(spot[:2], value[:2])}
        out[setting] = heads[BELOW], heads[LOSS], spot[2:], value[2:]
    return out


def ocsvm_fit(features: DataFrame, n_features: int, nus=NUS, kernels=KERNELS, landmarks: int = LANDMARKS) -> dict:
    """A machine per (kernel, nu), each within ``GAP`` of the optimum; its ``gap`` says how near.

    Equal rows are counted once, and every pass over the different rows serves all settings that are not done yet.
    """
    rows = stage(features.groupBy("indices", "values").agg(F.count("*").alias("n")), "vectors")
    n_rows = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if n_rows == 0:
        raise ValueError("no rows to fit on")
    gamma = gamma_scale(features, n_rows, n_features)
    marks = landmarks_of(rows, gamma, landmarks) if "rbf" in kernels else None
    root = marks.root() if marks else None
    square = F.aggregate("values", F.lit(0.0), lambda a, v: a + v * v)
    mean = {"linear": rows.agg(F.sum(square * F.col("n"))).first()[0] / n_rows, "rbf": 1.0}
    settings = [(k, nu) for k in kernels for nu in nus]
    bundles = [Bundle(k, nu, 1.0 / (nu * n_rows)) for k, nu in settings]

    def sums(points: dict) -> dict:
        """Run a pass; rbf points and sums change between vectors and landmarks."""
        sent = {s: (bundles[s].kernel, c, root @ w if bundles[s].kernel == "rbf" else w, rho) for s, (c, w, rho) in points.items()}
        used = marks if any(bundles[s].kernel == "rbf" for s in points) else None
        out = {}
        for s, (below, loss, spot, value) in _pass(rows, sent, used).items():
            if bundles[s].kernel == "rbf":
                value = root.T @ np.bincount(spot, weights=value, minlength=len(root)) if len(spot) else np.zeros(root.shape[1])
                spot = np.arange(len(value))
            out[s] = below, loss, spot, value
        return out

    none = np.empty(0, np.int64), np.empty(0)
    start = {s: (*((none[0], np.zeros(root.shape[1])) if b.kernel == "rbf" else none), math.inf) for s, b in enumerate(bundles)}
    for s, (below, _, spot, value) in sums(start).items():  # no rows and all rows: two vertices that any mixture can start from
        width = np.arange(root.shape[1]) if bundles[s].kernel == "rbf" else none[0]
        bundles[s].add(width, np.zeros(len(width)), 0.0)
        bundles[s].add(spot, value, below)
    while open_ := [s for s, b in enumerate(bundles) if not b.done]:
        points = {s: bundles[s].next() for s in open_}
        full = {}
        for s, (columns, w, rho, _) in points.items():
            if bundles[s].kernel == "rbf":
                w = np.bincount(columns, weights=w, minlength=root.shape[1])
            full[s] = columns, w, rho
        for s, (below, loss, spot, value) in sums(full).items():
            columns, w, rho, dual = points[s]
            bundles[s].judge(columns, w, rho, dual, loss, mean[bundles[s].kernel])
            bundles[s].add(spot, value, below)
    return {setting: _machine(bundle, gamma, marks, root, mean[bundle.kernel]) for setting, bundle in zip(settings, bundles)}


def _machine(bundle: Bundle, gamma: float, marks: Landmarks | None, root, mean_square: float) -> Machine:
    _, (columns, w), rho = bundle.best
    square = float(w @ w)
    if bundle.gap > GAP * max(square, VANISHED * mean_square):
        warnings.warn(f"one-class SVM ({bundle.kernel}, nu {bundle.nu}) ended at a gap of {bundle.gap:.3g}", stacklevel=2)
    slack = math.sqrt(2.0 * bundle.gap * mean_square)
    if bundle.kernel == "linear":
        return Machine("linear", bundle.nu, gamma, rho, slack, bundle.gap, columns, w)
    weights = root @ np.bincount(columns, weights=w, minlength=root.shape[1])
    return Machine("rbf", bundle.nu, gamma, rho, slack, bundle.gap, marks.columns, weights, marks)


def machine_table(spark, machine: Machine) -> DataFrame:
    """The stored form of a machine."""
    return spark.createDataFrame([Row(**r) for r in machine.rows().to_dict("records")], MACHINE)


def ocsvm_predict(features: DataFrame, model: dict) -> DataFrame:
    """Long form (kernel, nu, block_id, margin, pred): 1 if the margin is below rho by more than the certified error."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def margins(batches):
        for pdf in batches:
            for (kernel, nu), machine in shared.value.items():
                margin = machine.margins(pdf["indices"].to_numpy(), pdf["values"].to_numpy())
                yield pd.DataFrame({"kernel": kernel, "nu": nu, "block_id": pdf["block_id"], "margin": margin,
                                    "pred": (margin < machine.offset).astype(np.int32)})

    return features.select("block_id", "indices", "values").mapInPandas(
        margins, "kernel string, nu double, block_id string, margin double, pred int")
