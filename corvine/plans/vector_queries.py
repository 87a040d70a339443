"""Queries over the vector operators and their SQL; the query set is every row whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions import bits, sparse
from corvine.functions import vectors as V
from corvine.operators import aggregates, hnsw, ivf, knn
from corvine.session import once, table

K = 10


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors scaled by 1 + label, so that the metrics rank differently."""
    e = table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: (x.cast("double") * (1 + F.col("label"))).cast("float"))
    return e.select("vec_id", "label", scaled.alias("embedding"))


def _queries(rows: DataFrame) -> DataFrame:
    return rows.filter("vec_id % 100 = 0")


def _out(found: DataFrame) -> DataFrame:
    return found.select("query_id", "id", F.round("distance", 4).alias("distance"), F.col("place").cast("int").alias("place"))


def _knn(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _rows(spark, sf_dir)
        return _out(knn.knn_batch(rows, _queries(rows), K, metric))

    return run


def _bit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0).cast("float"))
    return table(spark, sf_dir, "embeddings").select("vec_id", sign.alias("embedding"))


def _knn_bits(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _bit_rows(spark, sf_dir)
        return _out(knn.knn_batch(rows, _queries(rows), K, metric))

    return run


def knn_to_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest to the row with id 0: the query vector comes from a scalar subquery."""
    rows = _rows(spark, sf_dir)
    q = rows.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    near = knn.knn(rows.crossJoin(F.broadcast(q)), F.col("q"), K, "l2")  # one row
    return near.select("vec_id", "label", F.round("distance", 4).alias("distance"))


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter stands below the search, so that every query gets its k rows."""
    rows = _rows(spark, sf_dir)
    return _out(knn.knn_batch(rows.filter("label >= 5 and vec_id % 3 = 0"), _queries(rows), K, "cosine"))


def range_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    q = rows.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return knn.within(rows.crossJoin(F.broadcast(q)), F.col("q"), 4.0).select("vec_id", F.round("distance", 4).alias("distance"))


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distances of every row to the row with id 0, in expressions."""
    rows = _rows(spark, sf_dir)
    q = rows.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    a, b = F.col("embedding"), F.col("q")
    r = lambda c, n: F.round(c, 4).alias(n)
    unit = lambda c: V.l2_normalize(c)
    return rows.crossJoin(F.broadcast(q)).select(
        "vec_id", r(V.l2_distance(a, b), "l2"), r(V.l2_squared_distance(a, b), "l2_squared"), r(V.inner_product(a, b), "ip"), r(V.negative_inner_product(a, b), "negative_ip"),
        r(V.cosine_distance(a, b), "cosine"), r(V.l1_distance(a, b), "l1"), F.round(V.spherical_distance(unit(a), unit(b)), 3).alias("spherical"),
    )


def _total(c, n):
    return F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias(n)


def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("embedding")
    b = F.reverse("embedding")
    return _rows(spark, sf_dir).select(
        "vec_id", V.vector_dims(a).alias("dims"), F.round(V.vector_norm(a), 4).alias("norm"), _total(V.vector_add(a, b), "added"), _total(F.slice(V.vector_sub(a, b), 1, 20), "subtracted"),
        _total(V.vector_mul(a, b), "multiplied"), V.vector_dims(V.vector_concat(a, b)).alias("concat_dims"), V.binary_quantize(a).alias("quantized"),
        _total(V.subvector(a, 5, 7), "sub_middle"), _total(V.subvector(a, -1, 4), "sub_left"), _total(V.subvector(a, 60, 100), "sub_right"), F.round(V.vector_norm(V.l2_normalize(a)), 4).alias("unit_norm"),
    )


def vector_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the next: comparison by elements, then length."""
    e = _rows(spark, sf_dir).select("vec_id", F.slice("embedding", 1, F.when(F.col("label") % 2 == 0, 64).otherwise(32)).alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(nxt, "vec_id").select("vec_id", V.vector_cmp("v", "w").alias("cmp"), (F.col("v") <= F.col("w")).alias("le"), (F.col("v") == F.col("v")).alias("eq"))


def vector_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the vectors that come back from the text, binary and sparse text forms."""
    a = F.col("embedding")
    rows = _rows(spark, sf_dir).withColumn("text", V.format_vector(a)).withColumn("bytes", V.send_vector(a))
    rows = once(rows.withColumn("binary", V.receive_vector("bytes")), s=sparse.from_dense(a))
    rows = once(rows, sparse_text=sparse.format_sparse(F.col("s")), parsed=V.parse_vector("text", 64))
    rows = once(once(rows, back=sparse.parse_sparse(F.col("sparse_text"))), dense=sparse.to_dense(F.col("back")))
    return rows.select("vec_id", _total(F.col("parsed"), "text_sum"), _total(F.col("binary"), "binary_sum"), _total(F.col("dense"), "sparse_sum"))


def _cells(df: DataFrame, c: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode(c).alias("pos", "x")).select(*keys, "pos", (F.round(F.col("x").cast("double"), 3) + 0.0).alias("x"))


def vec_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(aggregates.vector_avg(_rows(spark, sf_dir), "embedding"), "avg", [])


def vec_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(aggregates.vector_sum(_rows(spark, sf_dir), "embedding", ["label"]), "sum", ["label"])


def vec_avg_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(aggregates.vector_avg(_rows(spark, sf_dir), "embedding", ["label"]), "avg", ["label"])


def _sparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.transform("embedding", lambda x: F.when(F.abs(x) < 0.1, F.lit(0.0).cast("float")).otherwise(x))
    return table(spark, sf_dir, "embeddings").select("vec_id", sparse.from_dense(cut).alias("s"))


def sparse_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sparse_rows(spark, sf_dir)
    q = rows.filter("vec_id = 0").select(F.col("s").alias("q")).limit(1)
    a, b = F.col("s"), F.col("q")
    r = lambda c, n: F.round(c, 4).alias(n)
    return rows.crossJoin(F.broadcast(q)).select(
        "vec_id", F.size(a["indices"]).alias("nnz"), r(sparse.sparse_l2_distance(a, b), "l2"), r(sparse.sparse_inner_product(a, b), "ip"), r(sparse.sparse_l1_distance(a, b), "l1"),
        r(sparse.sparse_cosine_distance(a, b), "cosine"), r(sparse.sparse_norm(a), "norm"), sparse.sparse_cmp(a, b).alias("cmp"),
    )


def bit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.binary_quantize("embedding").alias("b"))
    q = rows.filter("vec_id = 0").select(F.col("b").alias("q")).limit(1)
    return rows.crossJoin(F.broadcast(q)).select(
        "vec_id", bits.hamming_distance(F.col("b"), F.col("q")).alias("hamming"), F.round(bits.jaccard_distance(F.col("b"), F.col("q")), 4).alias("jaccard")
    )


def rerank_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return _out(ivf.quantized_rerank(rows, _queries(rows), K, 50, "cosine"))


def rerank_subvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    short = rows.withColumn("embedding", V.subvector("embedding", 1, 16))
    near = knn.knn_batch(short, _queries(short), 40, "l2")
    return _out(ivf.rerank(near, rows, _queries(rows), K, "l2"))


def ivf_all_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probing all lists is the exact search."""
    rows = _rows(spark, sf_dir)
    index = ivf.build(rows, ivf.IvfOptions(lists=12, metric="l2", max_iterations=30))
    found = ivf.search(index, _queries(rows), K, probes=12)
    return _out(found)


def ivf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    index = ivf.build(rows, ivf.IvfOptions(lists=12, metric="cosine", max_iterations=30))
    return _out(ivf.search(index, _queries(rows), K, probes=3))


def ivf_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered search that goes on to further lists until it has enough rows."""
    rows = _rows(spark, sf_dir)
    index = ivf.build(rows, ivf.IvfOptions(lists=12, metric="l2", max_iterations=30))
    keep = rows.filter("label = 4").select("vec_id")
    few = ivf.IvfIndex(index.centres, index.options, index.table.join(keep, "vec_id", "left_semi"), index.id_col, index.vector)
    return _out(ivf.search(few, _queries(rows), K, probes=2, max_probes=12))


def ivf_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per list after inserting the odd ids and deleting those divisible by 5."""
    rows = _rows(spark, sf_dir)
    index = ivf.build(rows.filter("vec_id % 2 = 0"), ivf.IvfOptions(lists=8, metric="l2", max_iterations=30))
    index = ivf.bulk_delete(ivf.insert(index, rows.filter("vec_id % 2 = 1")), rows.filter("vec_id % 5 = 0"))
    return index.table.select("vec_id")


def ivf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return ivf.inertia(ivf.build(rows, ivf.IvfOptions(lists=8, metric="l2", max_iterations=30)))


def hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return _out(hnsw.search(hnsw.build(rows, hnsw.HnswOptions(metric="l2")), _queries(rows), K, ef_search=100))


def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the graph and of three probed lists against the exact search."""
    rows = _rows(spark, sf_dir)
    exact = knn.knn_batch(rows, _queries(rows), K, "l2").cache()
    lists = ivf.search(ivf.build(rows, ivf.IvfOptions(lists=12, metric="l2", max_iterations=30)), _queries(rows), K, probes=3)
    graph = hnsw.search(hnsw.build(rows, hnsw.HnswOptions(metric="l2")), _queries(rows), K, ef_search=100)
    named = lambda df, n: knn.recall(df, exact).select(F.lit(n).alias("index_kind"), "recall")
    return named(lists, "lists").unionByName(named(graph, "graph"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered SQL functions called from SQL text."""
    V.register(spark)
    _rows(spark, sf_dir).createOrReplaceTempView("corvine_vectors")
    return spark.sql(
        "SELECT vec_id, vector_dims(embedding) AS dims, round(vector_norm(embedding), 4) AS norm, round(l2_distance(embedding, reverse(embedding)), 4) AS l2,"
        " round(inner_product(embedding, reverse(embedding)), 4) AS ip, round(l1_distance(embedding, reverse(embedding)), 4) AS l1 FROM corvine_vectors"
    )


QUERIES = {
    "knn_l2": _knn("l2"), "knn_ip": _knn("ip"), "knn_cosine": _knn("cosine"), "knn_l1": _knn("l1"), "knn_hamming": _knn_bits("hamming"), "knn_jaccard": _knn_bits("jaccard"),
    "knn_to_row": knn_to_row, "knn_filtered": knn_filtered, "range_l2": range_l2, "vec_distances": distances, "vec_functions": vector_functions, "vec_order": vector_order,
    "vec_round_trips": vector_round_trips, "vec_avg": vec_avg, "vec_sum": vec_sum, "vec_avg_group": vec_avg_group, "sparse_distances": sparse_distances, "bit_distances": bit_distances,
    "rerank_binary": rerank_binary, "rerank_subvector": rerank_subvector, "ivf_all_probes": ivf_all_probes, "ivf_probe": ivf_probe,
    "ivf_iterative": ivf_iterative, "ivf_maintenance": ivf_maintenance, "ivf_quality": ivf_quality, "hnsw_search": hnsw_search, "index_recall": index_recall, "sql_functions": sql_functions,
}

# SQL of the queries

ROWS = "r AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) * (1 + label) AS FLOAT)) AS v FROM embeddings)"
BITS = "r AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0::FLOAT ELSE 0.0::FLOAT END) AS v FROM embeddings)"
Q = "q AS (SELECT vec_id AS query_id, v AS w FROM r WHERE vec_id % 100 = 0)"


def _zip(f: str, a: str = "v", b: str = "w") -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {f.format(a=f'CAST({a}[i] AS DOUBLE)', b=f'CAST({b}[i] AS DOUBLE)')}))"


DOT, SQUARES = _zip("{a} * {b}"), lambda c: _zip("{a} * {b}", c, c)
SQL_DISTANCE = {
    "l2": f"sqrt({_zip('({a} - {b}) * ({a} - {b})')})",
    "ip": f"-({DOT})",
    "cosine": f"1 - greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {DOT} / sqrt({SQUARES('v')} * {SQUARES('w')})))",
    "l1": _zip("abs({a} - {b})"),
    "hamming": _zip("abs({a} - {b})"),
    "jaccard": f"CASE WHEN {DOT} = 0 THEN 1.0::DOUBLE ELSE 1 - {DOT} / ({SQUARES('v')} + {SQUARES('w')} - {DOT}) END",
}


def _knn_sql(metric: str, rows: str = ROWS, where: str = "TRUE", k: int = K) -> str:
    return (
        f"WITH {rows}, {Q}, d AS (SELECT query_id, vec_id AS id, {SQL_DISTANCE[metric]} AS d FROM r CROSS JOIN q WHERE {where}),"
        " n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS place FROM d)"
        f" SELECT query_id, id, round(d, 4) AS distance, CAST(place AS INTEGER) AS place FROM n WHERE place <= {k}"
    )


ONE = "q AS (SELECT v AS w FROM r WHERE vec_id = 0)"
_ARRAYS = f"WITH {ROWS}, p AS (SELECT vec_id, label, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM r)"


def _sum_sql(expr: str, n: str) -> str:
    return f"round(list_sum(list_transform({expr}, lambda x: CAST(x AS DOUBLE))), 4) AS {n}"


def _each(f: str, lo: str = "1", hi: str = "len(v)") -> str:
    return f"list_transform(range({lo}, {hi} + 1), lambda i: CAST({f} AS FLOAT))"


_A, _B = "CAST(v[i] AS DOUBLE)", "CAST(v[len(v) + 1 - i] AS DOUBLE)"
SPARSE = "r AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN abs(x) < 0.1::DOUBLE THEN 0.0::FLOAT ELSE x END) AS v FROM embeddings)"

ORACLE = {
    **{f"knn_{m}": _knn_sql(m) for m in ("l2", "ip", "cosine", "l1")},
    "knn_hamming": _knn_sql("hamming", BITS),
    "knn_jaccard": _knn_sql("jaccard", BITS),
    "knn_filtered": _knn_sql("cosine", where="label >= 5 AND vec_id % 3 = 0"),
    "ivf_all_probes": _knn_sql("l2"),
    "knn_to_row": f"WITH {ROWS}, {ONE} SELECT vec_id, label, round(d, 4) AS distance FROM (SELECT vec_id, label, {SQL_DISTANCE['l2']} AS d FROM r CROSS JOIN q) ORDER BY d, vec_id LIMIT {K}",
    "range_l2": f"WITH {ROWS}, {ONE} SELECT vec_id, round(d, 4) AS distance FROM (SELECT vec_id, {SQL_DISTANCE['l2']} AS d FROM r CROSS JOIN q) WHERE d < 4.0",
    "vec_distances": f"WITH {ROWS}, {ONE} SELECT vec_id, round({SQL_DISTANCE['l2']}, 4) AS l2, round({_zip('({a} - {b}) * ({a} - {b})')}, 4) AS l2_squared, round({DOT}, 4) AS ip,"
    f" round(-({DOT}), 4) AS negative_ip, round({SQL_DISTANCE['cosine']}, 4) AS cosine, round({SQL_DISTANCE['l1']}, 4) AS l1,"
    f" round(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {DOT} / sqrt({SQUARES('v')} * {SQUARES('w')})))) / pi(), 3) AS spherical FROM r CROSS JOIN q",
    "vec_functions": f"WITH {ROWS} SELECT vec_id, CAST(len(v) AS INTEGER) AS dims, round(sqrt({SQUARES('v')}), 4) AS norm, {_sum_sql(_each(f'{_A} + {_B}'), 'added')},"
    f" {_sum_sql(_each(f'{_A} - {_B}', hi='20'), 'subtracted')}, {_sum_sql(_each(f'{_A} * {_B}'), 'multiplied')}, CAST(2 * len(v) AS INTEGER) AS concat_dims,"
    " array_to_string(list_transform(v, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS quantized,"
    f" {_sum_sql('v[5:11]', 'sub_middle')}, {_sum_sql('v[1:2]', 'sub_left')}, {_sum_sql('v[60:64]', 'sub_right')}, round(sqrt({SQUARES('v')}) / sqrt({SQUARES('v')}), 4) AS unit_norm FROM r",
    "vec_order": f"WITH {ROWS}, e AS (SELECT vec_id, CASE WHEN label % 2 = 0 THEN v ELSE v[1:32] END AS v FROM r)"
    " SELECT a.vec_id, CAST(CASE WHEN a.v < b.v THEN -1 WHEN a.v > b.v THEN 1 ELSE 0 END AS INTEGER) AS cmp, a.v <= b.v AS le, a.v = a.v AS eq FROM e a JOIN e b ON b.vec_id = a.vec_id + 1",
    "vec_round_trips": f"WITH {ROWS} SELECT vec_id, {_sum_sql('v', 'text_sum')}, {_sum_sql('v', 'binary_sum')}, {_sum_sql('v', 'sparse_sum')} FROM r",
    "vec_avg": f"{_ARRAYS} SELECT CAST(pos AS INTEGER) AS pos, round(CAST(CAST(avg(CAST(x AS DOUBLE)) AS FLOAT) AS DOUBLE), 3) + 0.0::DOUBLE AS x FROM p GROUP BY pos",
    "vec_sum": f"{_ARRAYS} SELECT label, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(sum(CAST(x AS DOUBLE)) AS FLOAT) AS DOUBLE), 3) + 0.0::DOUBLE AS x FROM p GROUP BY label, pos",
    "vec_avg_group": f"{_ARRAYS} SELECT label, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(avg(CAST(x AS DOUBLE)) AS FLOAT) AS DOUBLE), 3) + 0.0::DOUBLE AS x FROM p GROUP BY label, pos",
    "sparse_distances": f"WITH {SPARSE}, {ONE} SELECT vec_id, CAST(len(list_filter(v, lambda x: x <> 0)) AS INTEGER) AS nnz, round({SQL_DISTANCE['l2']}, 4) AS l2, round({DOT}, 4) AS ip,"
    f" round({SQL_DISTANCE['l1']}, 4) AS l1, round({SQL_DISTANCE['cosine']}, 4) AS cosine, round(sqrt({SQUARES('v')}), 4) AS norm,"
    " CAST(CASE WHEN v < w THEN -1 WHEN v > w THEN 1 ELSE 0 END AS INTEGER) AS cmp FROM r CROSS JOIN q",
    "bit_distances": f"WITH {BITS}, {ONE} SELECT vec_id, {SQL_DISTANCE['hamming']} AS hamming, round({SQL_DISTANCE['jaccard']}, 4) AS jaccard FROM r CROSS JOIN q",
    "rerank_binary": f"WITH {ROWS}, s AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN x > 0 THEN 1.0::FLOAT ELSE 0.0::FLOAT END) AS b, v FROM r),"
    f" near AS (SELECT a.vec_id AS query_id, a.v AS w, s.vec_id AS id, s.v, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_zip('abs({a} - {b})', 's.b', 'a.b')}, s.vec_id) AS n"
    f" FROM s CROSS JOIN s a WHERE a.vec_id % 100 = 0), d AS (SELECT query_id, id, {SQL_DISTANCE['cosine']} AS d FROM near WHERE n <= 50),"
    f" o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS place FROM d) SELECT query_id, id, round(d, 4) AS distance, CAST(place AS INTEGER) AS place FROM o WHERE place <= {K}",
    "rerank_subvector": f"WITH {ROWS}, near AS (SELECT a.vec_id AS query_id, a.v AS w, r.vec_id AS id, r.v, row_number() OVER (PARTITION BY a.vec_id ORDER BY"
    f" round(sqrt({_zip('({a} - {b}) * ({a} - {b})', 'r.v[1:16]', 'a.v')}), 9), r.vec_id) AS n FROM r CROSS JOIN r a WHERE a.vec_id % 100 = 0),"
    f" d AS (SELECT query_id, id, {SQL_DISTANCE['l2']} AS d FROM near WHERE n <= 40),"
    f" o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS place FROM d) SELECT query_id, id, round(d, 4) AS distance, CAST(place AS INTEGER) AS place FROM o WHERE place <= {K}",
    "ivf_maintenance": "SELECT vec_id FROM embeddings WHERE vec_id % 5 <> 0",
    "sql_functions": f"WITH {ROWS}, z AS (SELECT vec_id, v, list_reverse(v) AS w FROM r) SELECT vec_id, CAST(len(v) AS INTEGER) AS dims, round(sqrt({SQUARES('v')}), 4) AS norm,"
    f" round({SQL_DISTANCE['l2']}, 4) AS l2, round({DOT}, 4) AS ip, round({SQL_DISTANCE['l1']}, 4) AS l1 FROM z",
}
