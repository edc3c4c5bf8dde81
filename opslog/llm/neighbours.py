"""Approximate nearest neighbours by a hierarchical k-means tree and best-bin-first search.

The tree is grown on a bounded sample and every vector is put into one of its leaves. A query walks
the tree through a priority queue, nearest centre first, and visits leaves in that order. How many it
visits is widened on the sample until the wanted share of true neighbours lies in the visited leaves.
Vectors are compared in the visited leaves only, exactly, in double precision.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from opslog.llm import arrays
from opslog.session import stage

#: Vectors the tree is grown on at most; queries it is calibrated with; wanted recall.
SAMPLE, TRIALS, RECALL = 20_000, 300, 0.97
BRANCH, LEAF_ROWS, ROUNDS = 8, 64, 8
#: Rows of a leaf, and queries of a leaf, that one group compares.
CHUNK, QUERY_CHUNK = 512, 512
LEAST = 10


@dataclass
class Tree:
    """Centres of all nodes; the children of a node are a range of nodes, a leaf has none."""

    centres: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    leaf: np.ndarray  # number of the leaf, -1 inside

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        out = np.empty(len(x), np.int64)
        work = [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            below = np.arange(self.begin[node], self.end[node])
            near = squares(x[rows], self.centres[below]).argmin(axis=1)
            work += [(int(child), rows[near == k]) for k, child in enumerate(below) if (near == k).any()]
        return out

    def visit(self, q: np.ndarray):
        """Leaves in the order of a best-bin-first walk."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                yield int(self.leaf[node])
                continue
            below = slice(self.begin[node], self.end[node])
            away = ((self.centres[below] - q) ** 2).sum(axis=1)
            for k, d in enumerate(away.tolist()):
                heapq.heappush(heap, (d, int(self.begin[node]) + k))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)


def _means(x: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """k-means of different vectors; at most ``k`` centres and the centre of every row."""
    centres = x[rng.integers(len(x))][None]
    near = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and near.max() > 0:
        pick = rng.choice(len(x), p=near / near.sum())
        centres = np.vstack([centres, x[pick]])
        near = np.minimum(near, ((x - x[pick]) ** 2).sum(axis=1))
    for _ in range(ROUNDS):
        own = squares(x, centres).argmin(axis=1)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = (sums / np.maximum(count, 1)[:, None])[count > 0]
    return centres, squares(x, centres).argmin(axis=1)


def grow(x: np.ndarray, leaf_rows: int = LEAF_ROWS, seed: int = 7) -> Tree:
    """Split the sample by k-means until a node has at most ``leaf_rows`` rows or equal ones."""
    rng = np.random.default_rng(seed)
    centres, begin, end, leaf = [x.mean(axis=0)], [0], [0], [-1]
    work, leaves = [(0, np.arange(len(x)))], 0
    while work:
        node, rows = work.pop(0)
        made = None
        if len(rows) > leaf_rows:
            made, own = _means(x[rows], BRANCH, rng)
        if made is None or len(made) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        begin[node], end[node] = len(centres), len(centres) + len(made)
        for k, c in enumerate(made):
            work.append((len(centres), rows[own == k]))
            centres.append(c)
            begin.append(0)
            end.append(0)
            leaf.append(-1)
    return Tree(np.array(centres), np.array(begin), np.array(end), np.array(leaf))


def widen(tree: Tree, x: np.ndarray, k: int, recall: float = RECALL, trials: int = TRIALS) -> int:
    """Leaves to visit so that on the sample ``recall`` of the true neighbours are met."""
    own = tree.place(x)
    leaves = int(tree.leaf.max()) + 1
    step = max(len(x) // trials, 1)
    ranks = []
    for i in range(0, len(x), step):
        away = ((x - x[i]) ** 2).sum(axis=1)
        away[i] = np.inf
        true = np.argsort(away, kind="stable")[:min(k, len(x) - 1)]
        order = np.empty(leaves, np.int64)
        order[list(tree.visit(x[i]))] = np.arange(leaves)
        ranks += order[own[true]].tolist()
    return int(np.quantile(ranks, recall, method="higher")) + 1 if ranks else 1


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows with a key and a vector that is not null, empty or zero and holds finite numbers only."""
    v = F.col(vector)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(
        ~bad & F.exists(v, lambda e: e != 0)).select(F.col(key).alias("id"), v.cast("array<double>").alias("v"))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def build(points: DataFrame, k: int, sample: int = SAMPLE) -> tuple[Tree, int]:
    """The tree and the number of leaves to visit, from at most ``sample`` vectors."""
    rows = points.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    x = np.array([r.v for r in rows], np.float64)
    tree = grow(x)
    return tree, widen(tree, x, k)


def nearest(vectors: DataFrame, k: int = LEAST, queries: DataFrame | None = None, key: str = "vec_id",
            vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (Euclidean distance) of the ``k`` nearest found.

    ``queries`` has the same columns, by default all vectors are queries; a vector is never its own
    neighbour. Leaves are visited until the calibrated number is reached and ``k`` candidates are in
    them, so fewer rows come back only if there are fewer candidates. A leaf's rows and queries
    are compared in chunks, so a leaf with very many rows is many tasks.

    Edge cases: null, empty or zero vectors and those with null or non-finite components take no part,
    nor do vectors of another length than the most common one; ties go to the smaller key; equal vectors are neighbours at distance 0; rows that repeat a key are one another's own
    and not neighbours; an empty table gives an empty table; other columns are ignored.
    """
    spark = vectors.sparkSession
    points = valid(vectors, key, vector)
    asked = valid(queries if queries is not None else vectors, key, vector)
    kind = vectors.schema[key].dataType.simpleString()
    shape = f"query_id {kind}, rank int, vec_id {kind}, score double"
    head = points.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if head is None:
        return spark.createDataFrame([], shape)
    points, asked = points.where(F.size("v") == head.n), asked.where(F.size("v") == head.n)
    tree, visits = build(points, k, sample)
    sent = spark.sparkContext.broadcast(tree)

    def place(batch: pa.RecordBatch):
        yield batch.append_column("leaf", pa.array(sent.value.place(_matrix(batch.column(1)))))

    index = stage(arrays.map_batches(points, place, f"id {kind}, v array<double>, leaf long"), "leaves")
    # one row a leaf, and the tree has at most as many leaves as the sample has vectors
    counts = index.groupBy("leaf").agg(F.count("*").alias("n"))
    held = np.zeros(int(tree.leaf.max()) + 1, np.int64)
    for r in counts.collect():
        held[r.leaf] = r.n

    def walk(batch: pa.RecordBatch):
        own, rows, leaves = sent.value, [], []
        for i, q in enumerate(_matrix(batch.column(1))):
            seen = met = 0
            for leaf in own.visit(q):
                seen += 1
                if held[leaf]:
                    met += held[leaf]
                    rows.append(i)
                    leaves.append(leaf)
                if seen >= visits and met > k:
                    break
        yield batch.take(pa.array(rows, pa.int64())).append_column("leaf", pa.array(leaves, pa.int64()))

    walked = stage(arrays.map_batches(asked, walk, f"id {kind}, v array<double>, leaf long"), "visits")
    load = walked.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_CHUNK).cast("int").alias("sides"))
    plan = F.broadcast(counts.join(load, "leaf").withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("int")))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(plan, "leaf").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select(
        "leaf", "part", spread("sides").alias("side"), "id", "v")
    right = walked.join(plan, "leaf").withColumn("side", F.pmod(F.xxhash64("id"), F.col("sides")).cast("int")).select(
        "leaf", spread("parts").alias("part"), "side", "id", "v")

    def compare(there: pa.Table, here: pa.Table) -> pa.Table:
        if not there.num_rows or not here.num_rows:
            return pa.table({"query_id": here.column("id").slice(0, 0), "vec_id": there.column("id").slice(0, 0),
                             "score": pa.array([], pa.float64())})
        there = there.sort_by("id")
        x, q = _matrix(there.column("v")), _matrix(here.column("v"))
        ids, names = there.column("id").to_pandas(), here.column("id").to_pandas()
        out = []
        for i, name in enumerate(names):
            away = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
            other = np.flatnonzero((ids != name).to_numpy())
            best = other[np.argsort(away[other], kind="stable")[:k]]
            out.append(pd.DataFrame({"query_id": name, "vec_id": ids.iloc[best].to_numpy(), "score": away[best]}))
        return pa.Table.from_pandas(pd.concat(out), preserve_index=False)

    keys = ("leaf", "part", "side")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        compare, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
