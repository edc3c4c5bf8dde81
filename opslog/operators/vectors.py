"""Embeddings and exact nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from opslog.functions.text import runbook_search_text, tokenize
from opslog.operators.ranking import top_k_per_query
from opslog.schema import EMBEDDING_DIM

DIGITS = 6
BLOCK_VECTORS = 4096
QUERY_BATCH = 512
BATCHES_PER_TASK = 64
SHARED_BYTES = 256 * 1024 * 1024
#: Pairs measured at a time in single and in double precision, and rows given out at a time.
PAIR_CELLS, PAIR_ROWS, OUT_ROWS = 4_000_000, 16_384, 100_000


def hashed_bag(text: Column, dim: int = EMBEDDING_DIM) -> Column:
    """Default encoder: signed hashed bag of tokens of unit length.

    A token's hash is the first 15 hex digits of its md5, which any engine can
    repeat: its lowest bit is the sign, the rest modulo ``dim`` the place.
    Tokens are hashed in the JVM; only the small hash arrays reach Python.
    """
    @F.pandas_udf("array<float>")
    def pack(hashes: pd.Series) -> pd.Series:
        out = []
        for h in hashes:
            h = np.asarray(h, dtype=np.int64)
            signs = np.where(h & 1, 1.0, -1.0)
            bag = np.bincount((h >> 1) % dim, weights=signs, minlength=dim) if len(h) else np.zeros(dim)
            norm = np.linalg.norm(bag)
            out.append((bag / norm if norm else bag).astype(np.float32))
        return pd.Series(out)

    return pack(F.transform(tokenize(text), lambda t: F.conv(F.substring(F.md5(t), 1, 15), 16, 10).cast("long")))


def embed_texts(df: DataFrame, text: str, out: str = "embedding",
                encoder: Callable[[Column], Column] = hashed_bag) -> DataFrame:
    """Add an embedding column. ``encoder`` maps a text column to array<float>."""
    return df.withColumn(out, encoder(F.col(text)))


def index_runbooks(runbooks: DataFrame, encoder: Callable[[Column], Column] = hashed_bag) -> DataFrame:
    """Vector table (runbook_id, embedding) of the runbooks."""
    texts = runbooks.select(
        F.col("id").alias("runbook_id"),
        runbook_search_text(F.col("title"), F.col("category"), F.col("content")).alias("_text"),
    )
    return embed_texts(texts, "_text", encoder=encoder).drop("_text")


def nearest_columns(distances: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` smallest rounded distances per row, equal ones by column."""
    width = distances.shape[1]
    if width > k and distances.max() * 10 ** DIGITS * width < 2 ** 62:
        # Distance and column in one integer: partitioning it cannot mix up ties.
        keys = np.rint(distances * 10 ** DIGITS).astype(np.int64) * width + np.arange(width)
        return np.sort(np.partition(keys, k - 1, axis=1)[:, :k], axis=1) % width
    return np.argsort(distances, axis=1, kind="stable")[:, :k]


class _Nearest:
    """The ``k`` nearest vectors so far of each row of ``queries``, while blocks of vectors pass by.

    A block is first measured in single precision. Its rounding is bounded, so only vectors that may be among
    the nearest by that bound are measured in double precision; the result is that of measuring all so.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.k, self.queries, n = k, queries, len(queries)
        self.squares = (queries * queries).sum(axis=1)
        with np.errstate(all="ignore"):
            self.single = np.column_stack([queries, np.ones(n)]).astype(np.float32)
        self.filled, self.distance = np.zeros(n * k, dtype=bool), np.zeros(n * k)
        self.id, self.absent = None, np.zeros(n * k, dtype=bool)
        self.worst = np.full(n, np.inf)  # of k found

    def add(self, ids: np.ndarray, absent: np.ndarray, vectors: np.ndarray) -> None:
        if not len(vectors):
            return
        order = np.lexsort((ids, ~absent))
        ids, absent, vectors = ids[order], absent[order], vectors[order]
        squares = (vectors * vectors).sum(axis=1)
        step = max(1, PAIR_CELLS // len(vectors))
        with np.errstate(all="ignore"):
            single = np.column_stack([vectors, -0.5 * squares]).astype(np.float32).T
            for low in range(0, len(self.queries), step):
                full = np.isinf(self.worst[low:low + step])
                found = [self._all(low + np.flatnonzero(full), vectors, squares)] if full.any() else []
                if not full.all():
                    found += self._near(low + np.flatnonzero(~full), vectors, squares, single)
                self._merge(ids, absent, *map(np.concatenate, zip(*found)))

    def _all(self, rows: np.ndarray, vectors: np.ndarray, squares: np.ndarray) -> tuple:
        """The block's best for rows that have found fewer than ``k`` so far."""
        d = self.squares[rows][:, None] + squares - 2.0 * (self.queries[rows] @ vectors.T)
        d = np.round(np.maximum(d, 0.0), DIGITS) + 0.0
        best = nearest_columns(d, self.k)
        return np.repeat(rows, best.shape[1]), best.ravel(), np.take_along_axis(d, best, axis=1).ravel()

    def _near(self, rows: np.ndarray, vectors: np.ndarray, squares: np.ndarray, single: np.ndarray) -> list[tuple]:
        """What may be nearer than the worst of the ``k`` found, measured."""
        # q.v - v.v/2 is larger the nearer; its rounding is at most ``slack``
        own, longest, worst = self.squares[rows], squares.max(), self.worst[rows]
        close = self.single[rows] @ single
        slack = (len(single) + 16) * 2.0 ** -22 * (np.sqrt(own * longest) + longest + own + worst + 1e-30)
        edge = 0.5 * (own - worst - 10.0 ** -DIGITS) - slack
        at = np.flatnonzero(~(close < edge.astype(np.float32)[:, None]).ravel())  # what is no number is measured as well
        found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
        for i in range(0, len(at), PAIR_ROWS):
            row, column = rows[at[i:i + PAIR_ROWS] // len(vectors)], at[i:i + PAIR_ROWS] % len(vectors)
            d = self.squares[row] + squares[column] - 2.0 * np.einsum("ij,ij->i", self.queries[row], vectors[column])
            d = np.round(np.maximum(d, 0.0), DIGITS) + 0.0
            keep = ~(d > self.worst[row])
            found.append((row[keep], column[keep], d[keep]))
        return found

    def _merge(self, ids: np.ndarray, absent: np.ndarray, rows: np.ndarray, columns: np.ndarray, distances: np.ndarray) -> None:
        """Keep the ``k`` best of each row in ``rows``, whose entries so far are slots of fixed places."""
        if not len(rows):
            return
        touched, old = np.unique(rows), self.filled
        slots = (touched[:, None] * self.k + np.arange(self.k)).ravel()
        if self.id is None or self.id.dtype != (kind := np.promote_types(self.id.dtype, ids.dtype)):
            self.id = np.zeros(len(old), dtype=ids.dtype) if self.id is None else self.id.astype(kind)
        slots = slots[old[slots]]
        row = np.concatenate([slots // self.k, rows])
        distance = np.concatenate([self.distance[slots], distances])
        own = np.concatenate([self.id[slots], ids[columns]])
        gone = np.concatenate([self.absent[slots], absent[columns]])
        order = np.lexsort((own, ~gone, distance, row))
        row = row[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        best = place < self.k
        to, order, last = row[best] * self.k + place[best], order[best], place[best] == self.k - 1
        self.filled[to], self.distance[to], self.id[to], self.absent[to] = True, distance[order], own[order], gone[order]
        worst = distance[order[last]]
        self.worst[row[best][last]] = np.where(np.isnan(worst), np.inf, worst)

    def rows(self) -> np.ndarray:
        """Places of the entries found; the row is the place divided by ``k``."""
        return np.flatnonzero(self.filled)


def _matrix(column: pa.Array, dim: int | None) -> np.ndarray:
    """Rows of a batch's list column in double precision, all of one dimension."""
    sizes = pc.list_value_length(column)
    if column.null_count:
        raise ValueError("vectors must not be null")
    low, high = pc.min(sizes).as_py(), pc.max(sizes).as_py()
    if low != high:
        raise ValueError("vectors of different dimensions")
    if dim is not None and low != dim:
        raise ValueError("queries and vectors differ in dimension")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), low)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch, and where there is none."""
    absent = column.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(column.type):
        return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), absent
    return np.array([x or "" for x in column.to_pylist()], dtype=str), absent


def knn_l2(queries: DataFrame, vectors: DataFrame, k: int, query: str = "query_id",
           vector: str = "runbook_id", block_vectors: int = BLOCK_VECTORS, query_batch: int = QUERY_BATCH,
           shared_bytes: int = SHARED_BYTES, batches_per_task: int = BATCHES_PER_TASK) -> DataFrame:
    """The ``k`` nearest vectors of each query by squared L2 distance, exactly.

    Queries are dealt into groups of about ``query_batch * batches_per_task``. A task holds the queries of a
    group and their nearest so far, while all vectors pass by in blocks, so neither side has to fit a machine,
    no pairs are written and nothing is broadcast. The vectors are shuffled once per group; an index of up to
    ``shared_bytes`` may go to smaller groups, as many as keep the cores busy. Distances are rounded before
    ranking; equal ones go by id.
    """
    spark = queries.sparkSession
    n = queries.count()
    groups = max(1, math.ceil(n / (query_batch * batches_per_task)))
    size = vectors.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0]
    if size * 4 <= shared_bytes:
        groups = max(groups, min(2 * spark.sparkContext.defaultParallelism, math.ceil(n / query_batch)))
    group = F.pmod(F.xxhash64(query, "embedding"), F.lit(groups)).cast("int")
    wide = "array<double>" if "double" in (queries.schema["embedding"].dataType.simpleString()
                                           + vectors.schema["embedding"].dataType.simpleString()) else "array<float>"
    embedding = F.col("embedding").cast(wide).alias("embedding")
    asked = queries.select(group.alias("_group"), F.lit(0).alias("_side"), F.col(query).alias("_q"),
                           F.lit(None).cast(vectors.schema[vector].dataType).alias("_v"), embedding)
    every = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"), F.lit(1).alias("_side"),
                           F.lit(None).cast(queries.schema[query].dataType).alias("_q"), F.col(vector).alias("_v"), embedding)
    # many more partitions than groups, so that few of them share one
    dealt = asked.unionByName(every).repartition(8 * groups, "_group").sortWithinPartitions("_group", "_side")
    types = {f.name: f.dataType.simpleString() for f in [queries.schema[query], vectors.schema[vector]]}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, best, here, kind = [], [], None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if best is None or best.id is None:
                return
            name, places = pa.concat_arrays(names), best.rows()
            for low in range(0, len(places), OUT_ROWS):
                at = places[low:low + OUT_ROWS]
                yield pa.RecordBatch.from_arrays([
                    name.take(pa.array(at // k)),
                    pa.array(best.id[at], mask=best.absent[at]).cast(kind),
                    pa.array(best.distance[at])], names=[query, vector, "distance"])

        for batch in batches:
            key = batch.column("_group").to_numpy() * 2 + batch.column("_side").to_numpy()
            edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
            for low, high in zip(edges, [*edges[1:], len(key)]):
                rows, (at, side) = batch.slice(low, high - low), divmod(int(key[low]), 2)
                if at != here:
                    yield from done()
                    held, names, best, here = [], [], None, at
                if side == 0:
                    held.append(_matrix(rows.column("embedding"), held[0].shape[1] if held else None))
                    names.append(rows.column("_q"))
                elif held:
                    best = best or _Nearest(np.concatenate(held), k)
                    kind = rows.column("_v").type
                    for i in range(0, len(rows), block_vectors):
                        block = rows.slice(i, block_vectors)
                        best.add(*_ids(block.column("_v")), _matrix(block.column("embedding"), best.queries.shape[1]))
        yield from done()

    near = dealt.mapInArrow(nearest, f"{query} {types[query]}, {vector} {types[vector]}, distance double")
    return top_k_per_query(near, query, [F.col("distance"), F.col(vector)], k)
