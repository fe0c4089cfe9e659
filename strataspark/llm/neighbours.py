"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a sample is cut into balanced partitions: parts start as capacity-bound
clusters, then nodes move to where most of their neighbours are while there is room.  A small
classifier (one hidden layer) learns in which partitions a vector's neighbours lie.  It puts every
row of the table into its most probable partition and routes a query to several; how many is
measured on the sample against brute force, so that recall stays above a target.  All rows of the
probed partitions are then ranked by their exact inner product in double precision.

The sample is bounded by ``SAMPLE`` rows; every row is indexed.  A partition is searched in blocks
of bounded size, by queries in chunks of bounded size, so that a crowded partition or a vector that
a third of all rows share needs no task of its own.

Vectors that are null, empty, zero, hold a null or a non-finite component, or have another length
than most take no part.  Rows that repeat a query's id are not candidates of that query; a query
id that repeats is answered once, for its smallest vector.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 6000  # rows that the partitions are learned from, at most
PARTS = 16
GRAPH = 12  # neighbours of a node in the graph
SLACK = 1.15  # how much larger than the mean a partition of the graph may be
TARGET = 0.96  # recall that the number of probed partitions must reach on the sample
HIDDEN = 64
STEPS = 400
BLOCK_ROWS = 8192
CHUNK_QUERIES = 16384


def _nearest(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` rows with the largest inner products, without ``own``."""
    found = []
    for at in range(0, len(queries), 1024):
        near = queries[at : at + 1024] @ rows.T
        near[np.arange(len(near)), own[at : at + 1024]] = -np.inf
        found.append(np.argpartition(-near, min(k, near.shape[1] - 1), axis=1)[:, :k])
    return np.vstack(found)


def _place(gain: np.ndarray, room: int) -> np.ndarray:
    """Each row's part of largest gain with room left; rows that gain most choose first."""
    free = np.full(gain.shape[1], room)
    out = np.zeros(len(gain), dtype=np.int64)
    spread = gain.max(axis=1) - np.partition(gain, -min(2, gain.shape[1]), axis=1)[:, -min(2, gain.shape[1])]
    for i in np.argsort(-spread, kind="stable"):
        for p in np.argsort(-gain[i], kind="stable"):
            if free[p]:
                out[i], free[p] = p, free[p] - 1
                break
    return out


def partition_graph(rows: np.ndarray, graph: np.ndarray, parts: int, seed: int = 1) -> np.ndarray:
    """A balanced part of every node of a neighbour graph."""
    rng = np.random.default_rng(seed)
    room = int(np.ceil(len(rows) / parts * SLACK))
    centres = rows[rng.choice(len(rows), parts, replace=False)]
    part = np.zeros(len(rows), dtype=np.int64)
    for _ in range(6):
        part = _place(rows @ centres.T, room)
        sums = np.zeros_like(centres)
        np.add.at(sums, part, rows)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 0, sums / np.maximum(lengths, 1e-12), centres)
    mean = rows @ centres.T
    for _ in range(8):
        votes = np.zeros((len(rows), parts))
        for column in graph.T:
            votes[np.arange(len(rows)), part[column]] += 1.0
            np.add.at(votes, (column, part), 1.0)
        moved = _place(votes + 0.5 * (np.arange(parts) == part[:, None]) + 1e-3 * mean, room)
        if (moved == part).all():
            break
        part = moved
    return part


@dataclass
class Router:
    """Probabilities of partitions: one hidden layer."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(rows @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def order(self, rows: np.ndarray) -> np.ndarray:
        """Partitions by descending probability."""
        return np.argsort(-self.logits(rows), axis=1, kind="stable")


def train_router(rows: np.ndarray, wanted: np.ndarray, seed: int = 1) -> Router:
    """Cross-entropy against the shares of a row's neighbours by partition, by Adam."""
    rng = np.random.default_rng(seed)
    dims, parts = rows.shape[1], wanted.shape[1]
    scale = 1 / max(float(np.sqrt((rows**2).sum(axis=1).mean())), 1e-12)
    weights = [
        rng.normal(0, np.sqrt(2.0), (dims, HIDDEN)) * scale,
        np.zeros(HIDDEN),
        rng.normal(0, np.sqrt(1.0 / HIDDEN), (HIDDEN, parts)),
        np.zeros(parts),
    ]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        at = rng.integers(0, len(rows), 512)
        x, y = rows[at], wanted[at]
        hidden = np.maximum(x @ weights[0] + weights[1], 0)
        z = hidden @ weights[2] + weights[3]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        dz = (p - y) / len(at)
        dh = (dz @ weights[2].T) * (hidden > 0)
        slopes = [x.T @ dh, dh.sum(0), hidden.T @ dz, dz.sum(0)]
        for i, g in enumerate(slopes):
            g = g + 1e-5 * weights[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            move = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-9)
            weights[i] = weights[i] - 0.01 * (1 - 0.9 * step / STEPS) * move
    return Router(*weights)


def fit(rows: np.ndarray, k: int, parts: int = PARTS, target: float = TARGET) -> Router:
    """A router with the fewest probes whose recall on the sample reaches ``target``."""
    parts = max(1, min(parts, len(rows) // (4 * (k + 1))))
    dims = rows.shape[1]
    if parts < 2:
        zero = np.zeros((dims, 1))
        return Router(zero, np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    everyone = np.arange(len(rows))
    graph = _nearest(rows, rows, everyone, GRAPH)
    part = partition_graph(rows, graph, parts)
    near = part[graph]
    wanted = np.zeros((len(rows), parts))
    for column in near.T:
        wanted[everyone, column] += 1.0
    wanted[everyone, part] += 2.0
    router = train_router(rows, wanted / wanted.sum(axis=1, keepdims=True))
    some = everyone[:: max(1, len(rows) // 1000)]
    truth = _nearest(rows[some], rows, some, k)
    home = router.order(rows)[:, 0]
    rank = np.argsort(router.order(rows[some]), axis=1)
    at = np.sort(rank[np.arange(len(some))[:, None], home[truth]], axis=None)
    router.probes = 1 + int(at[min(len(at) - 1, int(np.ceil(target * len(at))) - 1)])
    return router


def valid(vector: str) -> Column:
    """Whether a vector takes part."""
    x = F.col(vector)
    odd = F.exists(
        x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    )
    return x.isNotNull() & (F.size(x) > 0) & ~odd & F.exists(x, lambda v: v != 0)


def _top(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest rows of a block to each query, by exact inner products."""
    names = ["query_id", "vec_id", "score"]
    if not len(queries) or not len(rows):
        return pd.DataFrame({n: [] for n in names})
    x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    ids = rows["vec_id"].to_numpy(np.int64)
    q = np.stack(queries["vector"].to_numpy()).astype(np.float64)
    own = queries["vec_id"].to_numpy(np.int64)
    band = 1e-9 * max(1.0, float(np.abs(x).max() * np.abs(q).max() * x.shape[1]))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), 512):
        near = q[at : at + 512] @ x.T
        near[own[at : at + 512, None] == ids[None, :]] = -np.inf
        if near.shape[1] > k:
            least = -np.partition(-near, k - 1, axis=1)[:, k - 1]
        else:
            least = np.full(len(near), -np.inf)
        for i in range(len(near)):
            # Rounding of the matrix product must not decide ties: sums are taken anew, alike.
            some = np.flatnonzero((near[i] >= least[i] - band) & (near[i] > -np.inf))
            exact = (x[some] * q[at + i]).sum(axis=1)
            best = np.lexsort((ids[some], -exact))[:k]
            out.append((np.full(len(best), own[at + i]), ids[some][best], exact[best]))
    return pd.DataFrame({n: np.concatenate([o[j] for o in out]) for j, n in enumerate(names)})


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, target: float = TARGET
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` for ``vectors (vec_id, embedding)``.

    ``is_query`` chooses the queries; all rows are candidates but the query's own.
    """
    rows = vectors.where(valid("embedding") & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    dims = usual["n"] if usual else 1
    rows = rows.where(F.size("vector") == dims)
    sample = (
        rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).select("vector").toPandas()
    )
    learned = np.stack(sample["vector"].to_numpy()) if len(sample) else np.zeros((0, dims))
    router = fit(learned, k, PARTS, target)
    probes = router.probes

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                order = router.order(np.stack(frame["vector"].to_numpy()))
                frame["part"] = order[:, 0].astype(np.int32)
                asks = frame["asks"].to_numpy()
                frame["probes"] = [
                    o[:probes].astype(np.int32) if a else None
                    for o, a in zip(order, asks, strict=True)
                ]
                yield frame

    routed = cut_lineage(
        rows.mapInPandas(
            route, "vec_id long, vector array<double>, asks boolean, part int, probes array<int>"
        )
    )
    sizes = dict(routed.groupBy("part").agg(F.count(F.lit(1))).collect())  # a row per partition
    asked = routed.where("asks").agg(F.count(F.lit(1))).first()[0]
    chunks = max(1, -(-asked // CHUNK_QUERIES))
    blocks = [max(1, -(-sizes.get(p, 0) // BLOCK_ROWS)) for p in range(max(sizes, default=0) + 1)]
    of_part = F.array(*[F.lit(b) for b in blocks])

    def dealt(column: str, by: Column) -> Column:
        return F.pmod(F.xxhash64(column, F.lit(7)), by).cast("int")

    n_blocks = F.coalesce(F.get(of_part, F.col("part")), F.lit(1))
    one_each = Window.partitionBy("vec_id").orderBy("vector")
    queries = (
        routed.where("asks")
        .withColumn("_nth", F.row_number().over(one_each))
        .where("_nth = 1")
        .select("vec_id", "vector", F.explode("probes").alias("part"))
        .select(
            "vec_id",
            "vector",
            "part",
            F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"),
            dealt("vec_id", F.lit(chunks)).alias("chunk"),
        )
    )
    candidates = routed.select(
        "vec_id",
        "vector",
        "part",
        F.pmod(F.xxhash64("vec_id", "vector"), n_blocks).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
    )
    keys = ["part", "block", "chunk"]
    near = (
        queries.groupBy(*keys)
        .cogroup(candidates.groupBy(*keys))
        .applyInPandas(lambda q, c: _top(q, c, k), "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        near.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
