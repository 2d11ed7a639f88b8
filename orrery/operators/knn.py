"""Exact nearest neighbours of a stated query set against all rows.

Queries are few and go to every task in blocks of bounded size; base rows never
move. A task keeps the best k of its rows for each query. Matrix products in
double precision select what can be among them, with a margin for rounding; the
distances kept are then summed from left to right, as the column functions do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.vectors import METRICS

#: A block of queries sent to all tasks has at most so many numbers.
BLOCK_NUMBERS = 1 << 24


def ordered_sum(x: np.ndarray) -> np.ndarray:
    """Sums of rows, from left to right."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j]
    return out


def exact(metric: str, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of one query to rows of b."""
    if metric == "l2":
        return ordered_sum((q - b) ** 2)
    dot = ordered_sum(q * b)
    if metric == "inner_product":
        return -dot
    both = np.sqrt(ordered_sum(q[None] ** 2)) * np.sqrt(ordered_sum(b ** 2))
    return np.where(both == 0, 1.0, 1.0 - dot / np.where(both == 0, 1.0, both))


def approximate(metric: str, q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all queries to all rows by matrix products, and what rounding can make of them."""
    dot, qn, bn = q @ b.T, (q * q).sum(1)[:, None], (b * b).sum(1)[None]
    if metric == "l2":
        d = qn + bn - 2 * dot
    elif metric == "inner_product":
        d = -dot
    else:
        both = np.sqrt(qn * bn)
        d = np.where(both == 0, 1.0, 1.0 - dot / np.where(both == 0, 1.0, both))
    return d, 1e-9 * (qn + bn + 1)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def query_blocks(queries: DataFrame, id_col: str, vec_col: str, more: list[str], most: int | None = None) -> Iterator[tuple]:
    """Ids, vectors and other columns of the queries, in blocks of bounded size. most: of so many queries."""
    ids, vectors, others = [], [], []
    for row in queries.select(id_col, vec_col, *more).toLocalIterator(prefetchPartitions=True):
        ids.append(row[0])
        vectors.append(row[1])
        others.append(tuple(row[2:]))
        if len(ids) * len(row[1]) >= BLOCK_NUMBERS or len(ids) == most:
            yield np.array(ids), np.array(vectors, dtype=np.float64), others
            ids, vectors, others = [], [], []
    if ids:
        yield np.array(ids), np.array(vectors, dtype=np.float64), others


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", radius: float | None = None, match: tuple[str, str] | None = None, without_self: bool = False, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(qid, id, dist, rank): the k nearest base rows of each query, ties by id.

    radius: only within that distance; k may then be 0 for all of them.
    match: a query's column and a base row's column that must be equal.
    Rows without a vector are left out.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    if k < 0 or (k == 0 and radius is None):
        raise ValueError("k must be positive, or zero with a radius")
    spark = base.sparkSession
    source = base.filter(F.col(vec_col).isNotNull()).select(id_col, vec_col, *([match[1]] if match else []))
    parts = []
    for ids, vectors, others in query_blocks(queries.filter(F.col(vec_col).isNotNull()), id_col, vec_col, [match[0]] if match else []):
        sent = spark.sparkContext.broadcast((ids, vectors, [o[0] for o in others] if match else None))
        parts.append(source.mapInArrow(_nearest(sent, k, metric, radius, without_self), "qid bigint, id bigint, dist double"))
    if not parts:
        return spark.createDataFrame([], "qid bigint, id bigint, dist double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id")))
    return out.filter(F.col("rank") <= k) if k else out


def _nearest(sent, k: int, metric: str, radius: float | None, without_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, wanted = sent.value
        if not k:
            yield from _within(batches, ids, queries, wanted, metric, radius, without_self)
            return
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            own, vectors = batch.column(0).to_numpy(), matrix(batch.column(1))
            near, margin = approximate(metric, queries, vectors)
            have = np.array(batch.column(2).to_pylist(), dtype=object) if wanted is not None else None
            for i, qid in enumerate(ids):
                ok = np.ones(len(own), dtype=bool)
                if wanted is not None:
                    ok &= (have == wanted[i]) & (wanted[i] is not None)
                if without_self:
                    ok &= own != qid
                if radius is not None:
                    ok &= near[i] <= radius + margin[i]
                d, held = best[i]
                if k and len(d) >= k:
                    ok &= near[i] <= d[k - 1] + margin[i]
                elif k and ok.sum() > k:
                    kth = np.partition(near[i][ok], k - 1)[k - 1]
                    ok &= near[i] <= kth + 2 * margin[i].max()
                if not ok.any():
                    continue
                d, held = np.concatenate([d, exact(metric, queries[i], vectors[ok])]), np.concatenate([held, own[ok]])
                if radius is not None:
                    d, held = d[d <= radius], held[d <= radius]
                order = np.lexsort((held, d))[: k or None]
                best[i] = d[order], held[order]
        n = [len(d) for d, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(np.concatenate([h for _, h in best] or [[]]).astype(np.int64)), pa.array(np.concatenate([d for d, _ in best] or [[]]).astype(np.float64))], names=["qid", "id", "dist"])

    return run


#: Queries that a batch of rows is compared with at once, and pairs whose exact distances are computed at once.
QUERIES_AT_ONCE, PAIRS_AT_ONCE = 1024, 1 << 16


def _within(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, wanted: list | None, metric: str, radius: float, without_self: bool) -> Iterator[pa.RecordBatch]:
    """All pairs within a radius, passed on batch by batch: a task keeps none."""
    asks = np.array(wanted, dtype=object) if wanted is not None else None
    for batch in batches:
        if not batch.num_rows:
            continue
        own, vectors = batch.column(0).to_numpy(), matrix(batch.column(1))
        have = np.array(batch.column(2).to_pylist(), dtype=object) if wanted is not None else None
        for a in range(0, len(ids), QUERIES_AT_ONCE):
            near, margin = approximate(metric, queries[a : a + QUERIES_AT_ONCE], vectors)
            rows, cols = np.nonzero(near <= radius + margin)
            rows += a
            ok = np.ones(len(rows), dtype=bool)
            if wanted is not None:
                ok &= (have[cols] == asks[rows]) & np.array([x is not None for x in asks], dtype=bool)[rows]
            if without_self:
                ok &= own[cols] != ids[rows]
            rows, cols = rows[ok], cols[ok]
            for b in range(0, len(rows), PAIRS_AT_ONCE):
                r, c = rows[b : b + PAIRS_AT_ONCE], cols[b : b + PAIRS_AT_ONCE]
                d = _pairs(metric, queries[r], vectors[c])
                r, c, d = r[d <= radius], c[d <= radius], d[d <= radius]
                yield pa.RecordBatch.from_arrays([pa.array(ids[r].astype(np.int64)), pa.array(own[c].astype(np.int64)), pa.array(d)], names=["qid", "id", "dist"])


def _pairs(metric: str, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """exact() of pairs, row by row."""
    if metric == "l2":
        return ordered_sum((q - b) ** 2)
    dot = ordered_sum(q * b)
    if metric == "inner_product":
        return -dot
    both = np.sqrt(ordered_sum(q ** 2)) * np.sqrt(ordered_sum(b ** 2))
    return np.where(both == 0, 1.0, 1.0 - dot / np.where(both == 0, 1.0, both))


def merge_top_k(results: DataFrame, k: int) -> DataFrame:
    """The best k of each query over several result lists (qid, id, dist, ...), without removing repeated ids."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id", *[c for c in results.columns if c not in ("qid", "id", "dist")]))
    return results.withColumn("rank", rank).filter(F.col("rank") <= k)
