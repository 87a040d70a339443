"""Layered proximity graphs: one graph per shard, searched shard by shard and merged.

A shard is a bounded slice of the table, so that a graph fits in a task; every shard is searched for
every query and the nearest rows overall win.  There is no insert, delete or repair, and the filtered
scan of Graph.search is not reached by search().
"""

from __future__ import annotations

import heapq
import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HnswOptions:
    m: int = 16
    ef_construction: int = 64
    metric: str = "l2"
    shard_rows: int = 20_000
    seed: int = 1

    def __post_init__(self):
        if not 2 <= self.m <= 100:
            raise ValueError("m must be 2 to 100")
        if not 4 <= self.ef_construction <= 1000:
            raise ValueError("ef_construction must be 4 to 1000")
        if self.ef_construction < 2 * self.m:
            raise ValueError("ef_construction must be at least twice m")


def _distance(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Ranking distance of one vector to rows; unit vectors are expected for cosine."""
    if metric == "l2":
        d = x - q
        return np.einsum("nd,nd->n", d, d)
    if metric in ("ip", "cosine"):
        return -(x @ q)
    if metric in ("l1", "hamming"):
        return np.abs(x - q).sum(axis=1)
    if metric == "jaccard":
        both = x @ q
        total = x.sum(axis=1) + q.sum() - both
        return 1 - np.where(both > 0, both / np.maximum(total, 1), 0.0)
    raise ValueError(f"unknown metric {metric}")


@dataclass
class Graph:
    options: HnswOptions
    x: np.ndarray
    ids: list[list[int]]
    """Row ids of each element: equal vectors share one."""
    layers: list[dict[int, list[int]]] = field(default_factory=list)
    entry: int = -1

    def near(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        return _distance(self.options.metric, q, self.x[nodes])

    def search_layer(self, q, entry: list[tuple[float, int]], ef: int, layer: int, seen: set | None = None, rest: list | None = None) -> list[tuple[float, int]]:
        """Best-first search: the ef nearest elements reached, nearest first; rest collects what fell out."""
        seen = set() if seen is None else seen
        seen.update(e for _, e in entry)
        todo = list(entry)
        heapq.heapify(todo)
        best = [(-d, e) for d, e in entry]
        heapq.heapify(best)
        links = self.layers[layer]
        while todo:
            d, e = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                if rest is not None:
                    rest.append((d, e))
                break
            fresh = [n for n in links.get(e, ()) if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for dn, n in zip(self.near(q, fresh).tolist(), fresh):
                if len(best) < ef or dn < -best[0][0]:
                    heapq.heappush(todo, (dn, n))
                    heapq.heappush(best, (-dn, n))
                    if len(best) > ef:
                        out = heapq.heappop(best)
                        if rest is not None:
                            rest.append((-out[0], out[1]))
                elif rest is not None:
                    rest.append((dn, n))
        if rest is not None:
            rest += todo
        return sorted((-d, e) for d, e in best)

    def choose(self, candidates: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours closer to the element than to any neighbour kept before; filled up with the pruned."""
        if len(candidates) <= 1:
            return [e for _, e in candidates]
        x = self.x[[e for _, e in candidates]]
        between = np.stack([_distance(self.options.metric, v, x) for v in x]).tolist()
        kept: list[int] = []
        pruned: list[int] = []
        for k, (d, _) in enumerate(candidates):
            if len(kept) >= most:
                break
            row = between[k]
            (kept if all(row[j] > d for j in kept) else pruned).append(k)
        return [candidates[k][1] for k in kept + pruned[: most - len(kept)]]

    def add(self, e: int, level: int) -> None:
        o, q = self.options, self.x[e]
        if self.entry < 0:
            self.layers = [{e: []} for _ in range(level + 1)]
            self.entry = e
            return
        top = len(self.layers) - 1
        at = [(float(self.near(q, [self.entry])[0]), self.entry)]
        for layer in range(top, level, -1):
            at = self.search_layer(q, at, 1, layer)[:1]
        for layer in range(min(level, top), -1, -1):
            at = self.search_layer(q, at, o.ef_construction, layer)
            most = o.m * 2 if layer == 0 else o.m
            chosen = self.choose(at, most)
            self.layers[layer][e] = chosen
            for n in chosen:
                links = self.layers[layer][n]
                links.append(e)
                if len(links) > most:
                    d = self.near(self.x[n], links).tolist()
                    self.layers[layer][n] = self.choose(sorted(zip(d, links)), most)
        for _ in range(top, level):
            self.layers.append({e: []})
        if level > top:
            self.entry = e

    def search(self, q: np.ndarray, ef: int, accept=None, wanted: int = 0, strict: bool = True, max_tuples: int = 20_000) -> list[tuple[float, int]]:
        """(distance, id) nearest first.  With ``accept`` the search goes on from what fell out until ``wanted``
        ids pass or max_tuples elements were seen; strict keeps the order of distance."""
        if self.entry < 0:
            return []
        at = [(float(self.near(q, [self.entry])[0]), self.entry)]
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self.search_layer(q, at, 1, layer)[:1]
        seen: set[int] = set()
        rest: list[tuple[float, int]] = []
        batch = self.search_layer(q, at, ef, 0, seen, rest)
        out: list[tuple[float, int]] = []
        last = -math.inf
        while True:
            for d, e in batch:
                if strict and d < last:
                    continue
                last = max(last, d)
                out += [(d, i) for i in self.ids[e] if accept is None or i in accept]
            if accept is None or len(out) >= wanted or not rest or len(seen) >= max_tuples:
                return out
            rest.sort()
            start, rest = rest[:ef], rest[ef:]
            batch = self.search_layer(q, start, ef, 0, seen, rest)


def build_graph(ids: list[int], x: np.ndarray, options: HnswOptions) -> Graph:
    """Graph of the rows; null rows must be left out before, zero vectors are left out under cosine."""
    x = np.asarray(x, np.float64)
    if options.metric == "cosine" and len(x):
        norm = np.linalg.norm(x, axis=1)
        ids, x = [i for i, n in zip(ids, norm) if n > 0], x[norm > 0] / norm[norm > 0, None]
    places: dict[bytes, int] = {}
    first, grouped = [], []
    for k, i in enumerate(ids):
        p = places.setdefault(x[k].tobytes(), len(first))
        if p == len(first):
            first.append(k)
            grouped.append([])
        grouped[p].append(i)
    g = Graph(options, x[first] if first else x, grouped)
    rng = np.random.default_rng(options.seed)
    scale = 1 / math.log(options.m)
    for e in range(len(first)):
        g.add(e, min(int(-math.log(rng.random() or 1e-12) * scale), 16))
    return g


@dataclass
class HnswIndex:
    shards: DataFrame
    """shard, graph: one serialised graph per shard."""
    options: HnswOptions
    id_col: str
    vector: str
    n_shards: int


def build(rows: DataFrame, options: HnswOptions = HnswOptions(), id_col: str = "vec_id", vector: str = "embedding") -> HnswIndex:
    """One graph per shard of about shard_rows rows; null vectors stay out, empty tables give an empty index."""
    data = rows.filter(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"))
    n = max(1, -(-data.count() // options.shard_rows))
    sharded = data.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        g = build_graph(pdf["id"].tolist(), np.stack(pdf["v"].to_list()), options)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "graph": [pickle.dumps(g)]})

    return HnswIndex(sharded.groupBy("shard").applyInPandas(make, "shard int, graph binary"), options, id_col, vector, n)


def search(index: HnswIndex, queries: DataFrame, k: int, ef_search: int = 40, max_queries: int = 4096) -> DataFrame:
    """query_id, id, distance, place: the k nearest rows over all shards, at most ef_search from each.

    The queries are held by every task and refused beyond max_queries.
    """
    if not 1 <= ef_search <= 1000:
        raise ValueError("ef_search must be 1 to 1000")
    asked = queries.filter(F.col(index.vector).isNotNull()).select(F.col(index.id_col).cast("bigint").alias("q"), F.col(index.vector).alias("v")).limit(max_queries + 1).collect()
    if len(asked) > max_queries:
        raise ValueError(f"more than {max_queries} queries")
    metric = index.options.metric
    held = [(r[0], np.asarray(r[1], np.float64)) for r in asked]

    def run(batches):
        for pdf in batches:
            rows = []
            for blob in pdf["graph"]:
                g = pickle.loads(blob)
                for qid, q in held:
                    v = q / (np.linalg.norm(q) or 1.0) if metric == "cosine" else q
                    for d, i in g.search(v, max(k, ef_search))[:k]:
                        rows.append((qid, i, math.sqrt(max(0.0, d)) if metric == "l2" else 1 + d if metric == "cosine" else d))
            yield pd.DataFrame(rows, columns=["query_id", "id", "distance"]).astype({"query_id": "int64", "id": "int64", "distance": "float64"})

    found = index.shards.select("graph").mapInPandas(run, "query_id bigint, id bigint, distance double")
    place = W.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return found.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)


def search_cost(tuples: int, m: int, ef_search: int) -> float:
    """Share of the rows a graph search looks at: entry levels times m, plus the base layer, over all."""
    if tuples <= 0:
        return 0.0
    levels = int(math.log(tuples) / math.log(m)) if tuples > 1 else 0
    return min(1.0, (levels * m + 0.55 * 2 * m * ef_search) / tuples)


def choose_path(tuples: int, ordered: bool, lists: int | None = None, probes: int = 1, m: int | None = None, ef_search: int = 40) -> str:
    """'exact', 'ivf' or 'hnsw': an index is used only for an ordered search with a limit and when it reads less."""
    costs = {"exact": 1.0}
    if ordered and lists:
        costs["ivf"] = min(1.0, probes / lists) + lists / max(1, tuples)
    if ordered and m:
        costs["hnsw"] = search_cost(tuples, m, ef_search)
    return min(costs, key=costs.get)
