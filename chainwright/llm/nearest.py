"""Approximate nearest neighbours: stable projections to few dimensions, indexed by a kd-tree.

Normal projections keep distances on average: the squared projected distance of a pair at distance d is d^2 times a
chi-square value with ``DIMENSIONS`` degrees of freedom. A query walks the leaves of the tree by their projected distance and verifies
their points on the original vectors. It stops once the next leaf lies so far that a point nearer than the k-th best
found would be projected there only with probability 1 - ``SURE``.

Distribution: rows are dealt by hash to blocks of about ``BLOCK`` rows, queries to blocks of ``QUERIES``; each pair of blocks is one
group with a tree of its own, and yields at most k rows a query, which are merged. Every row is indexed, and no group holds more
than a block. Equal rows collapse before they are dealt, so a repeated row does not fill a block.

Odd input: rows without an id, and vectors that are null, empty, zero or hold a null or a value that is not finite, take no part;
vectors of different lengths do not meet; a query has every row but those of its id as candidates; vectors that share
an id count with the nearest; ties go to the smaller id; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS, LEAF, SURE = 8, 256, 0.98
BLOCK, QUERIES = 32_768, 2_048
SEED = 7


def chi_square(x: float, n: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, n // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(p: float, n: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, n) < p else (low, mid)
    return high


def projection(length: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng([SEED, length]).standard_normal((length, dimensions))


def build(points: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Leaves of a kd-tree split at medians of the widest dimension: row numbers, and the lower and upper corners."""
    leaves, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            leaves.append(rows)
            continue
        values = points[rows]
        axis = int(np.argmax(values.max(0) - values.min(0)))
        half = len(rows) // 2
        order = np.argpartition(values[:, axis], half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return leaves, np.array([points[r].min(0) for r in leaves]), np.array([points[r].max(0) for r in leaves])


def _best(q: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query, an id once, ties to the smaller id."""
    order = np.lexsort((dist, ids, q))
    q, ids, dist = q[order], ids[order], dist[order]
    once = np.r_[True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])] if len(q) else np.zeros(0, bool)
    q, ids, dist = q[once], ids[once], dist[once]
    order = np.lexsort((ids, dist, q))
    q, ids, dist = q[order], ids[order], dist[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], ids[keep], dist[keep]


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, sure: float = SURE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, id and squared distance of the nearest rows found of one block."""
    basis = projection(queries.shape[1])
    leaves, low, high = build(vectors @ basis)
    seen = queries @ basis
    bound = np.stack([(np.maximum(np.maximum(low - p, p - high), 0) ** 2).sum(1) for p in seen])
    order = np.argsort(bound, 1, kind="stable")
    factor = quantile(sure, DIMENSIONS)
    norms, own = (vectors**2).sum(1), (queries**2).sum(1)
    unique = len(np.unique(ids)) == len(ids)
    kth = np.full(len(queries), np.inf)
    q, found, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    active = np.arange(len(queries))
    for r in range(len(leaves)):
        leaf = order[active, r]
        # a next leaf at the very same place as the k-th best may still hold a tie
        going = bound[active, leaf] <= factor * kth[active]
        active, leaf = active[going], leaf[going]
        if not len(active):
            break
        parts = [(q, found, dist)]
        by_leaf = np.argsort(leaf, kind="stable")
        for group in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
            who, rows = active[group], leaves[leaf[group[0]]]
            near = norms[rows] + own[who][:, None] - 2 * queries[who] @ vectors[rows].T
            near[query_ids[who][:, None] == ids[rows]] = np.inf
            limit = kth[who]
            if unique and len(rows) > k:
                limit = np.minimum(limit, np.partition(near, k - 1, 1)[:, k - 1])
            slack = 1e-11 * (own[who] + norms[rows].max())
            a, b = np.nonzero((near <= (limit + slack)[:, None]) & (near < np.inf))
            # the products above only choose; the distance itself comes from the differences
            parts.append((who[a], ids[rows[b]], ((queries[who[a]] - vectors[rows[b]]) ** 2).sum(1)))
        q, found, dist = _best(*map(np.concatenate, zip(*parts, strict=True)), k)
        last = np.flatnonzero(np.r_[q[1:] != q[:-1], True]) if len(q) else np.zeros(0, np.int64)
        full = last[(last - np.searchsorted(q, q[last])) == k - 1]
        kth[q[full]] = dist[full]
    return q, found, dist


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def nearest(rows: DataFrame, chosen: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, queries: int = QUERIES, sure: float = SURE) -> DataFrame:
    """The k nearest rows of each chosen row: ``query_id``, ``rank``, ``vec_id`` and ``score``, the Euclidean distance."""
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(chosen, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull()).where(F.coalesce(usable(F.col("v")), F.lit(False))).dropDuplicates(["id", "v", "asks"])
    n, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    many, much = max(1, math.ceil(n / block)), max(1, math.ceil(asking / queries))
    deal = lambda parts: F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    told = rows.select(F.lit(False).alias("asks"), "id", "v", deal(many).alias("b"), each(much).alias("a"))
    asked = rows.where("asks").select("asks", "id", "v", each(many).alias("b"), deal(much).alias("a"))

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks, ids = np.array(table["asks"]), np.array(table["id"], np.int64)
        width = len(table["v"][0])
        vectors = np.array(table["v"].combine_chunks().flatten(), np.float64).reshape(-1, width)
        if asks.all() or not asks.any():
            q, got, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            q, got, dist = search(ids[asks], vectors[asks], ids[~asks], vectors[~asks], k, sure)
        return pa.table({"query_id": ids[asks][q], "vec_id": got, "score": np.sqrt(dist)})

    met = told.unionByName(asked).withColumn("w", F.size("v")).groupBy("a", "b", "w").applyInArrow(work, "query_id long, vec_id long, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark, folder: str) -> DataFrame:
    """The ten nearest rows of ``embeddings`` for every row whose id is divisible by 100."""
    return nearest(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
