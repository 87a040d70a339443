"""Inverted-list index: k-means centres, one partition per list, probing of the nearest lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators.knn import distances, knn_batch, to_matrix, top_rows

DIM_LIMITS = {"vector": 2000, "halfvec": 4000, "bit": 64_000}


@dataclass(frozen=True)
class IvfOptions:
    lists: int = 100
    metric: str = "l2"
    max_iterations: int = 500
    seed: int = 1
    samples: int | None = None
    """Vectors the centres are fitted on; by default 50 per list and at least 10000."""

    def __post_init__(self):
        if not 1 <= self.lists <= 32_768:
            raise ValueError("lists must be 1 to 32768")
        if self.metric not in ("l2", "ip", "cosine", "hamming"):
            raise ValueError(f"no inverted lists for metric {self.metric}")

    @property
    def sample_size(self) -> int:
        return self.samples or max(50 * self.lists, 10_000)


def kmeans(x: np.ndarray, k: int, spherical: bool, iterations: int, rng: np.random.Generator, binary: bool = False) -> np.ndarray:
    """Centres by k-means++ seeding and Lloyd iterations; spherical centres are unit vectors, binary ones majorities.

    Without samples the centres are random; an emptied centre moves to a random sample.
    """
    if not len(x):
        c = rng.random((k, max(1, x.shape[1])))
        return c / np.linalg.norm(c, axis=1, keepdims=True) if spherical else c
    centres = np.empty((k, x.shape[1]))
    centres[0] = x[rng.integers(len(x))]
    nearest = ((x - centres[0]) ** 2).sum(axis=1)
    for j in range(1, k):
        total = nearest.sum()
        pick = rng.choice(len(x), p=nearest / total) if total > 0 else rng.integers(len(x))
        centres[j] = x[pick]
        nearest = np.minimum(nearest, ((x - centres[j]) ** 2).sum(axis=1))
    old = None
    for _ in range(iterations):
        of = ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
        if old is not None and (of == old).all():
            break
        old = of
        count = np.bincount(of, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        for j in np.flatnonzero(count == 0):
            sums[j], count[j] = x[rng.integers(len(x))], 1
        centres = sums / count[:, None]
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        elif binary:
            centres = (centres > 0.5).astype(float)
    return centres


def bit_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row places, 0/1 matrix) of a column of bit strings."""
    ok = np.flatnonzero(np.asarray(column.is_valid()))
    rows = [s.as_py() for s in column.drop_null()]
    return ok, np.array([[c == "1" for c in s] for s in rows], np.float32).reshape(len(rows), -1)


@dataclass
class IvfIndex:
    centres: np.ndarray
    options: IvfOptions
    table: DataFrame
    """id, vector and list, partitioned by list where it was written."""
    id_col: str
    vector: str

    def lists_by_distance(self, q: np.ndarray) -> np.ndarray:
        """Lists of each query from the nearest on."""
        metric = "l2" if self.options.metric in ("l2", "hamming") else "ip"
        return np.argsort(distances(metric, q, self.centres), axis=1, kind="stable")


def _assigner(centres: np.ndarray, options: IvfOptions, spark: SparkSession):
    held = spark.sparkContext.broadcast(centres)  # lists x dimensions

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = options.metric == "hamming"
            ok, x = (bit_matrix if bits else to_matrix)(batch.column(1))
            if options.metric == "cosine" and len(ok):
                norm = np.linalg.norm(x, axis=1)
                ok, x = ok[norm > 0], x[norm > 0]
            if len(ok):
                metric = "l2" if options.metric in ("l2", "hamming") else "ip"
                of = distances(metric, x, held.value).argmin(axis=1).astype(np.int32)
                take = pa.array(ok)
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(of)], names=[*batch.schema.names, "list"])

    return assign


def build(rows: DataFrame, options: IvfOptions = IvfOptions(), id_col: str = "vec_id", vector: str = "embedding", path: str | None = None) -> IvfIndex:
    """Fit centres on a bounded sample and assign every row; null and, for cosine, zero vectors stay out.

    With ``path`` the lists are written as partitions, so that a probe reads only its lists.  An empty
    table gives an index of random centres and no rows.
    """
    spark = rows.sparkSession
    data = rows.select(F.col(id_col).cast("bigint").alias(id_col), vector).filter(F.col(vector).isNotNull())
    n = data.count()
    share = min(1.0, 1.2 * options.sample_size / max(1, n))
    taken = (data if share >= 1 else data.sample(fraction=share, seed=options.seed)).limit(options.sample_size).toArrow().combine_chunks()
    bits = options.metric == "hamming"
    column = taken.column(vector).combine_chunks() if taken.num_rows else None
    x = (bit_matrix if bits else to_matrix)(column)[1].astype(float) if column is not None else np.zeros((0, 1))
    spherical = options.metric in ("ip", "cosine")
    if spherical and len(x):
        norm = np.linalg.norm(x, axis=1)
        x = x[norm > 0] / norm[norm > 0, None]
    limit = DIM_LIMITS["bit" if bits else "vector"]
    if x.shape[1] > limit:
        raise ValueError(f"column cannot have more than {limit} dimensions")
    if spherical and len(x) and x.shape[1] < 2:
        raise ValueError("dimensions must be greater than one for this metric")
    centres = kmeans(x, options.lists, spherical, options.max_iterations, np.random.default_rng(options.seed), bits)
    schema = f"`{id_col}` bigint, `{vector}` {data.schema[vector].dataType.simpleString()}, list int"
    table = data.mapInArrow(_assigner(centres, options, spark), schema)
    if path:
        table.repartition("list").write.mode("overwrite").partitionBy("list").parquet(path)
        table = spark.read.schema(schema).parquet(path)
    return IvfIndex(centres, options, table, id_col, vector)


def search(index: IvfIndex, queries: DataFrame, k: int, probes: int = 1, max_probes: int | None = None) -> DataFrame:
    """query_id, id, distance: the k nearest rows in the nearest ``probes`` lists of each query.

    With ``max_probes`` the search is iterative: queries with fewer than k rows take the next ``probes``
    lists until that many; the order holds within a batch.  Both are clamped to the number of lists.
    """
    options, spark = index.options, index.table.sparkSession
    probes = min(probes, options.lists)
    asked = queries.select(F.col(index.id_col).cast("bigint").alias("query_id"), F.col(index.vector).alias("__q")).filter("__q is not null")
    held = spark.sparkContext.broadcast(index.centres)
    top = min(max(probes, max_probes or probes), options.lists)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = (bit_matrix if options.metric == "hamming" else to_matrix)(batch.column(1))
            if len(ok):
                order = np.argsort(distances("l2" if options.metric in ("l2", "hamming") else "ip", x, held.value), axis=1, kind="stable")[:, :top]
                take = pa.array(np.repeat(ok, top))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(top, dtype=np.int32), len(ok)))],
                    names=["query_id", "__q", "list", "turn"],
                )

    kind = asked.schema["__q"].dataType.simpleString()
    routed = asked.mapInArrow(route, f"query_id bigint, __q {kind}, list int, turn int")
    from corvine.functions.bits import hamming_distance
    from corvine.functions.vectors import METRICS

    distance = hamming_distance if options.metric == "hamming" else METRICS[options.metric]
    joined = index.table.join(routed, "list").select(
        "query_id", F.col(index.id_col).alias("id"), distance(F.col(index.vector), F.col("__q")).alias("distance"), F.floor(F.col("turn") / probes).alias("batch")
    )
    from pyspark.sql import Window as W

    if max_probes:
        # a batch counts only while the batches before it gave fewer than k rows
        sizes = joined.groupBy("query_id", "batch").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("query_id").orderBy("batch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        joined = joined.join(sizes.withColumn("before", before).filter(F.col("before") < k).select("query_id", "batch"), ["query_id", "batch"])
    place = W.partitionBy("query_id").orderBy("batch", F.col("distance").asc_nulls_last(), "id")
    return joined.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k).select("query_id", "id", "distance", "place")


def insert(index: IvfIndex, rows: DataFrame, path: str | None = None, mode: str = "append") -> IvfIndex:
    """Add rows to their nearest lists; the centres stay.  With path they are written there, by list; mode as of a writer."""
    schema = f"`{index.id_col}` bigint, `{index.vector}` {index.table.schema[index.vector].dataType.simpleString()}, list int"
    new = rows.select(F.col(index.id_col).cast("bigint").alias(index.id_col), index.vector).mapInArrow(_assigner(index.centres, index.options, rows.sparkSession), schema)
    if path:
        new.write.mode(mode).partitionBy("list").parquet(path)
        return IvfIndex(index.centres, index.options, rows.sparkSession.read.schema(schema).parquet(path), index.id_col, index.vector)
    return IvfIndex(index.centres, index.options, index.table.unionByName(new), index.id_col, index.vector)


def bulk_delete(index: IvfIndex, ids: DataFrame) -> IvfIndex:
    """The index without the rows whose id is in ids."""
    kept = index.table.join(ids.select(F.col(index.id_col)).distinct(), index.id_col, "left_anti")
    return IvfIndex(index.centres, index.options, kept, index.id_col, index.vector)


def quantized_rerank(rows: DataFrame, queries: DataFrame, k: int, pool: int, metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Two stages: the pool nearest rows by Hamming distance of the sign bits, then k of them by the exact metric."""
    sign = F.transform(vector, lambda x: F.when(x > 0, 1.0).otherwise(0.0).cast("float"))
    near = knn_batch(rows.select(id_col, sign.alias(vector)), queries.select(id_col, sign.alias(vector)), pool, "l1", id_col, vector)
    return rerank(near, rows, queries, k, metric, id_col, vector)


def rerank(near: DataFrame, rows: DataFrame, queries: DataFrame, k: int, metric: str, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, id, distance, place: the k nearest of the candidate pairs by the exact metric."""
    from pyspark.sql import Window as W

    from corvine.functions.vectors import METRICS

    pairs = near.select("query_id", "id").join(rows.select(F.col(id_col).alias("id"), F.col(vector).alias("__x")), "id")
    pairs = pairs.join(queries.select(F.col(id_col).alias("query_id"), F.col(vector).alias("__q")), "query_id")
    d = pairs.select("query_id", "id", METRICS[metric](F.col("__x"), F.col("__q")).alias("distance"))
    place = W.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return d.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)


def davies_bouldin(index: IvfIndex) -> float:
    """Cluster quality of the lists: mean over lists of the worst (spread + spread) / centre distance."""
    centres = index.centres
    held = index.table.sparkSession.sparkContext.broadcast(centres)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = to_matrix(batch.column(0))
            of = np.asarray(batch.column(1))[ok]
            d = np.sqrt(((x - held.value[of]) ** 2).sum(axis=1)) if len(ok) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(d)], names=["list", "d"])

    s = dict(index.table.select(index.vector, "list").mapInArrow(spread, "list int, d double").groupBy("list").avg("d").collect())
    live = sorted(s)
    worst = []
    for i in live:
        others = [(s[i] + s[j]) / max(1e-12, float(np.linalg.norm(centres[i] - centres[j]))) for j in live if j != i]
        worst.append(max(others, default=0.0))
    return float(np.mean(worst)) if worst else 0.0


def inertia(index: IvfIndex) -> DataFrame:
    """list, n, inertia: rows and summed squared distance to the centre of each list."""
    held = index.table.sparkSession.sparkContext.broadcast(index.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = to_matrix(batch.column(0))
            of = np.asarray(batch.column(1))[ok]
            d = ((x - held.value[of]) ** 2).sum(axis=1).astype(float) if len(ok) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(d)], names=["list", "d"])

    return index.table.select(index.vector, "list").mapInArrow(run, "list int, d double").groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("inertia"))


__all__ = ["IvfIndex", "IvfOptions", "build", "bulk_delete", "davies_bouldin", "inertia", "insert", "kmeans", "quantized_rerank", "rerank", "search", "top_rows"]
