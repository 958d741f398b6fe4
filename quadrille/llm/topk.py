"""Exact search for the highest inner products, pruned by segment statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import written

#: Queries that are broadcast together: the bound of what the driver holds.
BLOCK = 4096
#: Segments of a vector at each resolution, coarse to fine.
LEVELS = (4, 16)
#: Candidates that a task works on at once.
ROWS = 1024
#: Components up to this size have exact inner products in doubles for a million dimensions.
_EXACT = 1 << 16
_LONG = (-(2**63), 2**63 - 1)


def integers(column: str = "embedding") -> Column:
    """floor(256 * x) of every component, x as double; null for a null vector or one with a null or non-finite component."""
    x = F.transform(F.col(column).cast("array<double>"), lambda v: F.floor(256 * v).cast("double"))
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False)), x)


def segments(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``parts`` segments of equal length (zeros fill the last): sqrt(length) times mean, and times deviation.

    By Cauchy's inequality the inner product of two vectors is at most the sum over
    segments of the products of these. That is the lower bound of their distance by
    means and deviations, solved for the inner product.
    """
    n, d = x.shape
    length = -(-d // parts)
    y = np.zeros((n, parts * length))
    y[:, :d] = x
    y = y.reshape(n, parts, length)
    mean = y.mean(2)
    return mean * np.sqrt(length), np.sqrt(np.maximum(0, (y**2).sum(2) - length * mean**2))


@dataclass
class Queries:
    """A block of queries of one dimension, their statistics, and a score that each one's k-th best reaches at least."""

    ids: np.ndarray
    x: np.ndarray
    stats: list[np.ndarray]
    floor: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray, k: int) -> Queries:
        """The floor is the k-th best among the block's own vectors: all of them are candidates too."""
        floor = np.full(len(ids), -np.inf)
        for at in range(0, len(ids), 512):
            s = _products(x[at : at + 512], x).astype(np.float64)
            s[ids[at : at + 512, None] == ids[None, :]] = -np.inf
            if s.shape[1] >= k:
                floor[at : at + 512] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        return cls(ids, x, [np.concatenate(segments(x, p), 1) for p in LEVELS], floor)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows: in doubles where they fit 53 bits, else in Python's integers."""
    if not a.size or not b.size or max(np.abs(a).max(), np.abs(b).max()) <= _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object)
    return whole(a) @ whole(b).T


class Best:
    """The k best candidates so far of every query of a block."""

    def __init__(self, queries: Queries, k: int):
        self.q, self.k = queries, k
        self.found: dict[int, list[tuple[int, int]]] = {}
        self.floor = queries.floor.copy()

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Prunes by the coarse, then the fine bound, and scores what is left; ties with the floor stay."""
        q = self.q
        slack = 1e-9 * (1 + np.linalg.norm(q.x, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
        alive = np.concatenate(segments(x, LEVELS[0]), 1)
        rows, cols = np.nonzero(q.stats[0] @ alive.T + slack >= self.floor[:, None])
        for level, parts in enumerate(LEVELS[1:], 1):
            other = np.concatenate(segments(x, parts), 1)
            keep = np.zeros(len(rows), bool)
            for at in range(0, len(rows), 1 << 18):
                r, c = rows[at : at + (1 << 18)], cols[at : at + (1 << 18)]
                keep[at : at + (1 << 18)] = np.einsum("ij,ij->i", q.stats[level][r], other[c]) + slack[r, c] >= self.floor[r]
            rows, cols = rows[keep], cols[keep]
        cuts = np.searchsorted(rows, np.arange(len(q.ids) + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            own = cols[cuts[i] : cuts[i + 1]]
            own = own[ids[own] != q.ids[i]]
            if not own.size:
                continue
            scores = _products(q.x[i : i + 1], x[own])[0]
            best = sorted(zip((-int(s) for s in scores), ids[own].tolist())) if len(own) <= 64 else self._few(scores, ids[own])
            held = sorted(self.found.get(int(i), []) + best[: self.k])[: self.k]
            self.found[int(i)] = held
            if len(held) == self.k:
                self.floor[i] = max(self.floor[i], float(-held[-1][0]))

    def _few(self, scores: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
        if scores.dtype == object:
            return sorted(zip((-int(s) for s in scores), ids.tolist()))[: self.k]
        order = np.lexsort((ids, -scores))[: self.k]
        return [(-int(scores[j]), int(ids[j])) for j in order]


def _vectors(batch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(1)
    some = np.array([len(v) for v in lists]) == dims if batch.num_rows else np.zeros(0, bool)
    picked = batch.filter(pa.array(some))
    x = picked.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return picked.column(0).to_numpy(zero_copy_only=False), x


def _scan(batches, block, k: int):
    """The best of a task's candidates for every query of the block."""
    kept = [Best(q, k) for q in block.value]
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for best in kept:
                ids, x = _vectors(batch.slice(at, ROWS), best.q.x.shape[1])
                if len(ids):
                    best.add(ids, x)
    rows = [(int(b.q.ids[i]), v, min(max(-s, _LONG[0]), _LONG[1])) for b in kept for i, found in b.found.items() for s, v in found]
    for at in range(0, len(rows), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 65536])], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k highest inner products of every query row with all rows of other ids.

    Vectors that are null, empty, or hold a null or non-finite component take no part, nor do
    null ids; vectors of different lengths aren't compared. Ties go to the smaller id.
    Equal rows are all candidates; a repeated query id is asked once, with its least
    vector. Scores beyond a long are held at its ends.

    An empty table gives no rows.

    Queries come in blocks of about ``block`` rows: each is broadcast and meets every
    partition of candidates, which keeps k rows a query. A task prunes by bounds from
    segment means and deviations against the best found so far, and scores survivors.
    Of several blocks, each one's best rows are written to the shared folder and its
    broadcast is dropped before the next comes, so that neither the driver, nor workers,
    nor the plan hold more than one block, and a lost executor costs one block's work.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), queries.alias("asked"), integers(vector_col).alias("x")).where("vec_id is not null and size(x) > 0")
    asked = rows.where("asked").groupBy("vec_id").agg(F.min("x").alias("x"))
    blocks = max(1, -(-asked.count() // block))
    order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    schema = "query_id long, vec_id long, score long"
    parts = []
    for b in range(blocks):
        part: dict[int, list] = {}
        for r in asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect():
            part.setdefault(len(r["x"]), []).append((r["vec_id"], r["x"]))
        made = [Queries.of(np.array([i for i, _ in p], np.int64), np.array([x for _, x in p], np.float64).reshape(len(p), d), k) for d, p in sorted(part.items())]
        shared = spark.sparkContext.broadcast(made)
        found = rows.select("vec_id", "x").mapInArrow(lambda it, shared=shared: _scan(it, shared, k), schema)
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks == 1:
            return ranked
        parts.append(written(ranked, "best")[1])
        shared.destroy()
    return spark.read.schema(ranked.schema).parquet(*parts)
