"""Most similar vectors for every vector by a forest of random-projection trees (problem 1).

The upper hyperplanes are fitted on a bounded sample on the driver; leaves that hold too many vectors
are then split further by hyperplanes fitted on samples of their own rows, in the executors, until no
leaf is too large: deep trees for large collections, deeper ones where near-copies crowd.  Every vector
is indexed in one leaf of each tree.  A query walks down all trees; every node where it could have gone
the other way enters one priority queue shared by all trees, and the closest entries are followed to
further leaves, whose own turns enter the queue too.  Queries and index rows meet in their leaf, where
a matrix product yields candidates, and candidates are reranked with the exact vectors.  Exact copies
are one vector in the forest and come back as ranked ids afterwards, so that a vector repeated in a
third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.session import bounded_broadcast, materialize

SMALL = 2_000_000
"""Most ids that are broadcast, 16 MB of them."""


@dataclass(frozen=True)
class ForestOptions:
    trees: int = 3
    leaf: int = 2000
    """Vectors aimed at in a leaf."""
    extra_leaves: int = 3
    """Leaves a query visits through the shared queue besides its own one in each tree, one more for each level beyond ``level``."""
    level: int = 7
    sample: int = 40_000
    """Most vectors the upper hyperplanes are fitted on, and about the most of one leaf that is split further."""
    crowd: float = 3.0
    """Times ``leaf`` beyond which a leaf is split further."""
    rounds: int = 12
    """Most rounds of splitting; a leaf that no hyperplane splits stays."""
    seed: int = 7


def hyperplanes(x: np.ndarray, levels: int, rng: np.random.Generator, root: int = 1, least: int = 24) -> dict[int, tuple[np.ndarray, float]]:
    """node -> (normal, offset) of up to ``levels`` levels below root; node k has the children 2k and 2k + 1.

    Of three directions between two of a node's rows the one with most spread is taken, cut at its
    median.  Nodes of fewer than ``least`` rows, or of equal ones, are not split.
    """
    out: dict[int, tuple[np.ndarray, float]] = {}
    held = {root: np.arange(len(x))}
    for _ in range(levels):
        below: dict[int, np.ndarray] = {}
        for node, rows in held.items():
            if len(rows) < least:
                continue
            best, spread, at = None, 0.0, None
            for _ in range(3):
                a, b = x[rng.choice(rows, 2, replace=False)]
                w = a - b
                if size := float(np.linalg.norm(w)):
                    p = x[rows] @ (w / size)
                    if (v := float(p.var())) > spread:
                        best, spread, at = w / size, v, p
            if best is None:
                continue
            cut = float(np.median(at))
            right = at > cut
            if right.any() and not right.all():
                out[node] = best.astype(np.float32), cut
                below |= {2 * node: rows[~right], 2 * node + 1: rows[right]}
        held = below
    return out


class Tree:
    """Hyperplanes by node number, in sorted arrays; a node without one is a leaf."""

    def __init__(self, nodes: dict[int, tuple[np.ndarray, float]], dim: int):
        self.keys = np.array(sorted(nodes), np.int64)
        self.normals = np.array([nodes[k][0] for k in self.keys.tolist()], np.float32).reshape(-1, dim)
        self.offsets = np.array([nodes[k][1] for k in self.keys.tolist()], np.float32)

    def with_nodes(self, more: dict[int, tuple[np.ndarray, float]]) -> Tree:
        old = {k: (w, float(o)) for k, w, o in zip(self.keys.tolist(), self.normals, self.offsets)}
        return Tree(old | more, self.normals.shape[1])

    def descend(self, x: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """(leaf of each row from its node down, turns): turns are (rows, node not taken, distance) by level."""
        node, rows, turns = node.copy(), np.arange(len(x)), []
        while len(rows) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, node[rows]), len(self.keys) - 1)
            inner = self.keys[at] == node[rows]
            rows, at = rows[inner], at[inner]
            if not len(rows):
                break
            m = np.einsum("nd,nd->n", x[rows], self.normals[at]) - self.offsets[at]
            taken = 2 * node[rows] + (m > 0)
            turns.append((rows, taken ^ 1, np.abs(m)))
            node[rows] = taken
        return node, turns


class Forest:
    def __init__(self, trees: list[Tree], extra: int):
        self.trees, self.extra = trees, extra

    @staticmethod
    def cell(node: np.ndarray, tree: int) -> np.ndarray:
        return (node << 8) | tree

    def own(self, x: np.ndarray) -> list[np.ndarray]:
        return [self.cell(t.descend(x, np.ones(len(x), np.int64))[0], k) for k, t in enumerate(self.trees)]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, own): own cells of all trees, then cells reached through the queue shared by all trees.

        An entry's priority is the greatest distance to a hyperplane on the way to it, so a turn below a
        turned node is never closer than that node.
        """
        n = len(x)
        rows, cells, mine = [], [], []
        queue: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # row, tree and node, priority

        def visit(some: np.ndarray, tree: int, node: np.ndarray, floor: np.ndarray, own: bool) -> None:
            leaf, turns = self.trees[tree].descend(x[some], node)
            rows.append(some)
            cells.append(self.cell(leaf, tree))
            mine.append(np.full(len(some), own))
            for r, other, far in turns:
                queue.append((some[r], self.cell(other, tree), np.maximum(far, floor[r])))

        for k in range(len(self.trees)):
            visit(np.arange(n), k, np.ones(n, np.int64), np.zeros(n, np.float32), True)
        for _ in range(self.extra):
            if not queue:
                break
            row, entry, far = (np.concatenate(p) for p in zip(*queue))
            order = np.lexsort((entry, far, row))
            first = order[np.r_[True, row[order][1:] != row[order][:-1]]]  # the closest entry of each row
            rest = np.ones(len(row), bool)
            rest[first] = False
            queue[:] = [(row[rest], entry[rest], far[rest])]
            for k in range(len(self.trees)):
                own = first[(entry[first] & 255) == k]
                if len(own):
                    visit(row[own], k, entry[own] >> 8, far[own], False)
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(mine)


CODE_ERROR = 1e-4
"""More than similarities of coded vectors are off by."""


def _clean(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of the usable rows of a batch of id and vector."""
    ids, lists = batch.column(0), batch.column(1)
    ok = np.asarray(ids.is_valid()) & (np.asarray(lists.value_lengths().fill_null(-1)) == dim)
    keep = pa.array(ok)
    x = np.asarray(lists.filter(keep).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        unit = (x[good] / norm[good, None]).astype(np.float32)
    return np.asarray(ids.filter(keep).cast(pa.int64()))[good], unit


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    flat = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(flat.shape[1]), len(rows), [None, pa.py_buffer(flat.tobytes())])
    return fixed.cast(pa.binary())


def _each_batch(df: DataFrame, dim: int, make, schema: str) -> DataFrame:
    """make(ids, unit vectors) -> columns, over the usable rows of df's id and vector columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, unit = _clean(batch, dim)
            if len(ids):
                yield pa.RecordBatch.from_arrays(make(ids, unit), names=names)

    return df.mapInArrow(run, schema)


def _hashes(ids: np.ndarray, unit: np.ndarray) -> list[pa.Array]:
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(v.tobytes()) for v in unit), np.int64).reshape(-1, 2)
    return [pa.array(ids), pa.array(digests[:, 0]), pa.array(digests[:, 1])]


def _coded(unit: np.ndarray) -> np.ndarray:
    """Two signed bytes per element and the scale as float32."""
    top = np.abs(unit).max(axis=1, keepdims=True)
    code = np.rint(unit / top * 32767).astype(np.int16).view(np.uint8)
    return np.concatenate([code, (top / 32767).astype(np.float32).view(np.uint8)], axis=1)


def _decoded(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * dim + 4)
    return flat[:, : 2 * dim].copy().view(np.int16).astype(np.float32) * flat[:, 2 * dim :].copy().view(np.float32)


def _candidates(cells: DataFrame, dim: int, k: int, least: float) -> DataFrame:
    """a, b: for each query in each cell up to 2k index rows, of those with similarity near least or above.

    The coded similarities choose twice k, so that coding costs a neighbour only where more than k others
    are within CODE_ERROR of it.
    """

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        own = np.flatnonzero(group.column("own").to_numpy())
        x = _decoded(group.column("code"), dim)
        xs, mine, out = ids[own], x[own], [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, len(ids) if len(xs) else 0, 1024):
            s = x[at : at + 1024] @ mine.T
            q = ids[at : at + 1024]
            r, c = np.nonzero(s >= least)
            keep = q[r] != xs[c]
            r, c = r[keep], c[keep]
            if (np.bincount(r, minlength=1) > 2 * k).any():
                order = np.lexsort((xs[c], -s[r, c], r))
                r, c = r[order], c[order]
                start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                size = np.diff(np.r_[start, len(r)])
                keep = np.arange(len(r)) - np.repeat(start, size) < 2 * k
                r, c = r[keep], c[keep]
            out.append((q[r], xs[c]))
        a, b = (np.concatenate(p) for p in zip(*out))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("cell").applyInArrow(run, "a bigint, b bigint")


def _split_further(unique: DataFrame, forest: Forest, dim: int, sizes: dict[int, int], options: ForestOptions) -> Forest:
    """The forest with hyperplanes below the leaves in ``sizes`` (cell -> rows), fitted where the rows are.

    Rows are sampled by a hash to about 48 for each leaf aimed at, at most ``sample`` of a leaf.
    """
    share = {c: min(1.0, 48 / options.leaf, options.sample / n) for c, n in sizes.items()}
    spread = df_broadcast(unique, (forest, share))

    def pick(ids: np.ndarray, unit: np.ndarray) -> list[pa.Array]:
        forest, share = spread.value
        u = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / 2.0**53
        rows, cells = [], []
        for own in forest.own(unit):
            take = np.flatnonzero(u < np.array([share.get(c, 0.0) for c in own.tolist()]))
            rows.append(take)
            cells.append(own[take])
        take = np.concatenate(rows)
        return [pa.array(np.concatenate(cells)), _fixed(unit[take])] if len(take) else [pa.array([], pa.int64()), pa.array([], pa.binary())]

    def fit(group: pa.Table) -> pa.Table:
        cell = group.column("cell")[0].as_py()
        x = np.frombuffer(b"".join(group.column("vec").to_pylist()), np.float32).reshape(-1, dim)
        x = x[np.lexsort(x.T[::-1])]  # the same planes in whatever order rows arrive
        levels = int(np.ceil(np.log2(max(2.0, sizes[cell] / options.leaf))))
        planes = hyperplanes(x, levels, np.random.default_rng(options.seed + cell % 1009), cell >> 8, least=8)
        return pa.table({
            "tree": pa.array([cell & 255] * len(planes), pa.int32()), "node": pa.array(list(planes), pa.int64()),
            "normal": pa.array([w.tobytes() for w, _ in planes.values()], pa.binary()), "cut": pa.array([c for _, c in planes.values()], pa.float64()),
        })

    # one row per hyperplane: a vector for about every ``leaf`` rows
    found = _each_batch(unique, dim, pick, "cell bigint, vec binary").groupBy("cell").applyInArrow(fit, "tree int, node bigint, normal binary, cut double")
    more: list[dict[int, tuple[np.ndarray, float]]] = [{} for _ in forest.trees]
    for r in found.toLocalIterator():
        more[r["tree"]][r["node"]] = np.frombuffer(r["normal"], np.float32), r["cut"]
    return Forest([t.with_nodes(m) if m else t for t, m in zip(forest.trees, more)], forest.extra)


def df_broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


def grown_forest(unique: DataFrame, sample: np.ndarray, total: int, dim: int, options: ForestOptions) -> Forest:
    """A forest whose leaves hold at most ``crowd`` times ``leaf`` of the vectors in unique(id, v), if planes can part them."""
    rng = np.random.default_rng(options.seed)
    depth = max(0, int(np.ceil(np.log2(max(1.0, total / options.leaf)))))
    forest = Forest([Tree(hyperplanes(sample, depth, rng), dim) for _ in range(options.trees)], options.extra_leaves + max(0, depth - options.level))
    stuck: set[int] = set()
    for _ in range(options.rounds):
        spread = df_broadcast(unique, forest)

        def count(ids: np.ndarray, unit: np.ndarray) -> list[pa.Array]:
            cells, n = np.unique(np.concatenate(spread.value.own(unit)), return_counts=True)  # noqa: B023
            return [pa.array(cells), pa.array(n)]

        counted = _each_batch(unique, dim, count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
        crowded = {r["cell"]: r["n"] for r in counted.filter(F.col("n") > options.crowd * options.leaf).toLocalIterator() if r["cell"] not in stuck}
        if not crowded:
            break
        before = [len(t.keys) for t in forest.trees]
        forest = _split_further(unique, forest, dim, crowded, options)
        inner = [set(t.keys.tolist()) for t in forest.trees]
        stuck |= {c for c in crowded if (c >> 8) not in inner[c & 255]}
        if before == [len(t.keys) for t in forest.trees]:
            break
    return forest


def similar_pairs(
    df: DataFrame, id_col: str = "id", vector: str = "embedding", dim: int = 64, k: int = 10, least: float = -1.0,
    options: ForestOptions = ForestOptions(),
) -> DataFrame:
    """a, b, similarity, place: for every usable vector a its k most similar b with cosine at least ``least``.

    Rows with a null id, a null or wrongly sized vector, a null, NaN or infinite element or all zeros
    have no neighbours and are none.  Ties in similarity go to the smaller id; exact copies of a vector
    are neighbours with similarity 1.  ids are expected to be unique; a row repeated with its id counts
    once.  Approximate only in that a neighbour may meet a query in none of the visited leaves; the
    similarities themselves are exact.  Empty tables and tables with one vector give no rows.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    hashed = _each_batch(source, dim, _hashes, "id bigint, h1 bigint, h2 bigint").groupBy("id", "h1", "h2").agg(F.count(F.lit(1)).alias("times"))
    groups = hashed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    members = materialize(hashed.join(groups, ["h1", "h2"]).select("id", "rep", "n", "times"), "members")
    repeated = members.filter("times > 1").select("id").distinct()
    if not repeated.isEmpty():  # equal rows of one id become one, pre-aggregated by the scan
        again = bounded_broadcast(repeated, SMALL)
        source = source.join(again, "id", "left_anti").unionByName(source.join(again, "id", "left_semi").distinct())
    copies = members.filter("n > 1")
    others_than_first = copies.filter("id <> rep").select("id")
    unique = source.join(bounded_broadcast(others_than_first, SMALL), "id", "left_anti")
    total = members.filter("id = rep").count()
    parts = max(1, int(total / options.sample))
    picked = unique.filter(F.pmod(F.xxhash64("id", F.lit(options.seed)), F.lit(parts)) == 0)
    taken = _each_batch(picked, dim, lambda ids, unit: [pa.array(ids), _fixed(unit)], "id bigint, vec binary")
    rows = taken.limit(2 * options.sample).toArrow().column("vec").to_pylist()
    sample = np.frombuffer(b"".join(rows), np.float32).reshape(-1, dim)
    # a plane for about every ``leaf`` rows and tree, dim + 1 floats each
    forest = df_broadcast(df, grown_forest(unique, sample, total, dim, options))

    def placed(ids: np.ndarray, unit: np.ndarray) -> list[pa.Array]:
        row, cell, own = forest.value.cells(unit)
        take = pa.array(row)
        return [pa.array(ids).take(take), pa.array(cell), pa.array(own), _fixed(_coded(unit)).take(take)]

    cells = _each_batch(unique, dim, placed, "id bigint, cell bigint, own boolean, code binary")
    near = _candidates(cells, dim, k + 1, least - CODE_ERROR)
    pairs = materialize(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    vectors = _each_batch(
        source.join(bounded_broadcast(wanted, SMALL), "id", "left_semi"), dim, lambda ids, unit: [pa.array(ids), _fixed(unit)], "id bigint, vec binary"
    )
    with_a = pairs.join(vectors.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a")
    both = with_a.join(vectors.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b").select("a", "b", "va", "vb")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float32).reshape(-1, dim).astype(np.float64) for c in (2, 3))
                s = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["a", "b", "s"])

    exactly = materialize(both.mapInArrow(exact, "a bigint, b bigint, s double").filter(F.col("s") >= least).distinct(), "pairs")
    directed = exactly.unionByName(exactly.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))

    # back to all ids: a group of copies is entered by its k + 1 smallest ids, which is all any list can use
    in_group = W.partitionBy("rep").orderBy("id")
    lowest = copies.withColumn("o", F.row_number().over(in_group)).filter(F.col("o") <= k + 1).select(F.col("rep").alias("b"), F.col("id").alias("low"))
    own = lowest.select(F.col("b").alias("a"), F.col("low").alias("to"), F.lit(1.0).alias("s"))
    others = directed.join(lowest, "b", "left").select("a", F.coalesce("low", "b").alias("to"), "s")
    listed = W.partitionBy("a").orderBy(F.col("s").desc(), "to")
    lists = own.unionByName(others).withColumn("o", F.row_number().over(listed)).filter(F.col("o") <= k + 1)
    lists = lists.groupBy(F.col("a").alias("rep")).agg(F.sort_array(F.collect_list(F.struct("o", "to", "s"))).alias("list"))
    by_id = members.join(lists, "rep").select(
        F.col("id").alias("a"), F.slice(F.filter("list", lambda x: x["to"] != F.col("id")), 1, k).alias("list")
    )
    return by_id.select("a", F.posexplode("list").alias("p", "x")).select(
        "a", F.col("x.to").alias("b"), F.col("x.s").alias("similarity"), (F.col("p") + 1).alias("place")
    )
