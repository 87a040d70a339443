"""Exact nearest neighbours: top-k per query, range search, two-stage re-ranking and recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.functions.vectors import METRICS

QUERY_BLOCK = 4096
"""Queries held by a task at a time; larger query sets are searched block by block."""


def distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distance of every query to every row, in double."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    if metric in ("l1", "hamming"):
        return np.stack([np.abs(x - v).sum(axis=1) for v in q]) if len(q) else np.zeros((0, len(x)))
    dot = q @ x.T
    if metric == "ip":
        return -dot
    if metric == "cosine":
        with np.errstate(all="ignore"):
            s = dot / np.sqrt((q * q).sum(1)[:, None] * (x * x).sum(1)[None, :])
        return 1 - np.clip(s, -1, 1)
    if metric == "jaccard":
        total = q.sum(axis=1)[:, None] + x.sum(axis=1)[None, :] - dot
        return 1 - np.where(dot > 0, dot / np.maximum(total, 1), 0.0)
    if metric == "l2":
        return np.sqrt(np.maximum(0.0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * dot))
    raise ValueError(f"unknown metric {metric}")


def to_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row places, matrix) of the non-null lists, which must have one length."""
    ok = np.flatnonzero(np.asarray(column.is_valid()))
    if not len(ok):
        return ok, np.zeros((0, 0), np.float32)
    sizes = set(np.asarray(column.drop_null().value_lengths()).tolist())
    if len(sizes) > 1:
        raise ValueError("different vector dimensions")
    return ok, np.asarray(column.drop_null().flatten(), np.float32).reshape(len(ok), -1)


def top_rows(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query place, row place) of each query's k nearest rows; ties by id, NaN last."""
    k = min(k, d.shape[1])
    if not k:
        return np.zeros(0, int), np.zeros(0, int)
    d = np.where(np.isnan(d), np.inf, d)
    if k < d.shape[1]:
        limit = np.partition(d, k - 1, axis=1)[:, k - 1]
        r, c = np.nonzero(d <= limit[:, None])
    else:
        r, c = np.nonzero(np.ones_like(d, bool))
    order = np.lexsort((ids[c], d[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


def knn_batch(
    rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding", exclude_self: bool = False,
) -> DataFrame:
    """query_id, id, distance, place: the k nearest rows of every query, ties by id.

    Each task compares its rows with a block of queries by matrix product and keeps k per query, so
    that k rows per query and task are shuffled.  Query sets above QUERY_BLOCK are searched block by
    block.  Null vectors are no rows and no queries; vectors of different length are an error.
    """
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("q"), F.col(vector).alias("v"))
    total = asked.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    found: DataFrame | None = None
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).toArrow().combine_chunks()
        qid = np.asarray(part.column("q").combine_chunks(), np.int64) if part.num_rows else np.zeros(0, np.int64)
        qv = to_matrix(part.column("v").combine_chunks())[1] if part.num_rows else np.zeros((0, 0), np.float32)
        held = rows.sparkSession.sparkContext.broadcast((qid, qv))  # at most about QUERY_BLOCK vectors

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qid, qv = held.value
            for batch in batches:
                ok, x = to_matrix(batch.column(1))
                if not len(ok) or not len(qid):
                    continue
                ids = np.asarray(batch.column(0))[ok].astype(np.int64)
                d = distances(metric, qv, x)
                if exclude_self:
                    d = np.where(qid[:, None] == ids[None, :], np.nan, d)
                r, c = top_rows(d, ids, k + 8)
                keep = ~np.isnan(d[r, c]) if exclude_self else np.ones(len(r), bool)
                r, c = r[keep], c[keep]
                yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(ids[c]), pa.array(d[r, c])], names=["query_id", "id", "distance"])

        part_found = rows.select(F.col(id_col).cast("bigint"), vector).mapInArrow(run, "query_id bigint, id bigint, distance double")
        found = part_found if found is None else found.unionByName(part_found)
    # near ties are settled by the rounded distance, so that the order of summation can't decide
    place = W.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return found.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)


def knn(rows: DataFrame, query: Column, k: int, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to one query vector: a projection and a bounded sort."""
    d = METRICS[metric](F.col(vector), query)
    return rows.withColumn("distance", d).orderBy(F.col("distance").asc_nulls_last(), id_col).limit(k)


def within(rows: DataFrame, query: Column, radius: float, metric: str = "l2", vector: str = "embedding") -> DataFrame:
    """Rows closer than radius."""
    return rows.withColumn("distance", METRICS[metric](F.col(vector), query)).filter(F.col("distance") < radius)


def recall(found: DataFrame, expected: DataFrame) -> DataFrame:
    """recall: share of the expected (query_id, id) pairs that were found."""
    e = expected.select("query_id", "id").distinct()
    hit = e.join(found.select("query_id", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
