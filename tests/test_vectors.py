import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvine.functions import bits, sparse
from corvine.functions import vectors as V
from corvine.operators import aggregates, hnsw, ivf, knn


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def vec(*xs):
    return F.array(*[F.lit(float(x)).cast("float") for x in xs])


def fails(spark, c, words):
    with pytest.raises(Exception, match=words):
        one(spark, c)


def test_distances(spark):
    a, b = vec(0, 0), vec(3, 4)
    assert one(spark, V.l2_distance(a, b)) == 5
    assert one(spark, V.inner_product(vec(1, 2), vec(3, 4))) == 11
    assert one(spark, V.negative_inner_product(vec(1, 2), vec(3, 4))) == -11
    assert one(spark, V.l1_distance(a, b)) == 7
    assert one(spark, V.cosine_distance(vec(1, 1), vec(-1, -1))) == pytest.approx(2)
    assert math.isnan(one(spark, V.cosine_distance(a, b)))
    assert one(spark, V.spherical_distance(vec(1, 0), vec(0, 1))) == pytest.approx(0.5)
    assert one(spark, V.l2_distance(a, F.lit(None).cast("array<float>"))) is None
    fails(spark, V.l2_distance(vec(1, 2), vec(1)), "different vector dimensions")


def test_arithmetic_and_subvector(spark):
    assert one(spark, V.vector_add(vec(1, 2, 3), vec(4, 5, 6))) == [5, 7, 9]
    assert one(spark, V.vector_mul(vec(1, 2, 3), vec(4, 5, 6))) == [4, 10, 18]
    fails(spark, V.vector_add(vec(3e38), vec(3e38)), "overflow")
    fails(spark, V.vector_mul(vec(1e-37), vec(1e-37)), "underflow")
    v = vec(1, 2, 3, 4, 5)
    assert one(spark, V.subvector(v, 1, 3)) == [1, 2, 3]
    assert one(spark, V.subvector(v, -1, 3)) == [1]
    assert one(spark, V.subvector(v, 3, 9)) == [3, 4, 5]
    fails(spark, V.subvector(v, -1, 2), "at least 1 dimension")
    fails(spark, V.subvector(v, 6, 1), "at least 1 dimension")
    assert one(spark, V.binary_quantize(vec(1, 0, -1))) == "100"
    assert one(spark, V.l2_normalize(vec(0, 0))) == [0, 0]
    assert one(spark, V.vector_cmp(vec(1, 2), vec(1, 2, 3))) == -1


def test_text_and_casts(spark):
    assert one(spark, V.parse_vector(F.lit(" [ 1, 2.5 ,-3e1 ] "))) == [1, 2.5, -30]
    assert one(spark, V.format_vector(vec(1, 2.5, -3))) == "[1,2.5,-3]"
    for bad in ("[]", "1,2", "[1,2", "[a]", "[1,,2]"):
        fails(spark, V.parse_vector(F.lit(bad)), "invalid input syntax")
    fails(spark, V.parse_vector(F.lit("[4e38]")), "out of range")
    fails(spark, V.to_vector(vec(1, 2), 3), "expected 3 dimensions")
    assert one(spark, V.to_vector(F.array(F.lit(1e-46)))) == [0]
    assert one(spark, V.receive_vector(V.send_vector(vec(1, 2)))) == [1, 2]
    assert one(spark, V.to_half(vec(1.0009765625, 2))) == [pytest.approx(1.0009765625), 2]


def test_bits(spark):
    a, b = F.lit("1" * 70), F.lit("0" * 69 + "1")
    assert one(spark, bits.hamming_distance(a, b)) == 69
    assert one(spark, bits.jaccard_distance(F.lit("1100"), F.lit("1010"))) == pytest.approx(2 / 3)
    assert one(spark, bits.hamming_distance(F.lit(""), F.lit(""))) == 0
    assert one(spark, bits.jaccard_distance(F.lit("00"), F.lit("00"))) == 1
    fails(spark, bits.hamming_distance(F.lit("1"), F.lit("11")), "different bit lengths")


def test_sparse(spark):
    s = sparse.parse_sparse(F.lit("{3:2,1:1.5,2:0}/5"))
    assert one(spark, sparse.format_sparse(s)) == "{1:1.5,3:2}/5"
    assert one(spark, sparse.to_dense(s)) == [1.5, 0, 2, 0, 0]
    fails(spark, sparse.parse_sparse(F.lit("{1:1,1:2}/5")), "duplicates")
    fails(spark, sparse.parse_sparse(F.lit("{6:1}/5")), "out of bounds")
    t = sparse.parse_sparse(F.lit("{1:1.5,4:-1}/5"))
    assert one(spark, sparse.sparse_l2_distance(s, t)) == pytest.approx(math.sqrt(5))
    assert one(spark, sparse.sparse_cmp(s, t)) == 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-10, 10, width=32), min_size=3, max_size=3), st.lists(st.floats(-10, 10, width=32), min_size=3, max_size=3))
def test_numpy_distances_follow_their_definitions(a, b):
    x, y = np.array([a], np.float32), np.array([b], np.float32)
    assert knn.distances("l2", x, y)[0, 0] == pytest.approx(math.dist(a, b), abs=1e-4)
    assert knn.distances("l1", x, y)[0, 0] == pytest.approx(sum(abs(p - q) for p, q in zip(a, b)), abs=1e-4)


def test_aggregates(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (1, None), (None, [5.0, 5.0]), (2, None)], "k int, v array<float>")
    avg = {r["k"]: r["avg"] for r in aggregates.vector_avg(df, "v", ["k"]).collect()}
    assert avg == {1: [2, 3], None: [5, 5], 2: None}
    assert aggregates.vector_sum(df, "v").first()[0] == [9, 11]
    assert aggregates.vector_avg(df.limit(0), "v").first()[0] is None
    mixed = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<float>")
    with pytest.raises(Exception, match="different vector dimensions"):
        aggregates.vector_avg(mixed, "v").collect()


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(i, [float(x) for x in rng.random(3)]) for i in range(600)], "vec_id bigint, embedding array<float>").cache()


def test_indexes_reach_the_recall_floors(spark, cloud):
    q = cloud.filter("vec_id % 100 = 0")
    exact = knn.knn_batch(cloud, q, 20, "l2").cache()
    index = ivf.build(cloud, ivf.IvfOptions(lists=10, max_iterations=20))
    recall = lambda df: knn.recall(df, exact).first()[0]
    assert recall(ivf.search(index, q, 20, probes=10)) == 1
    assert recall(ivf.search(index, q, 20, probes=4)) >= 0.8
    assert ivf.search(index, q, 20, probes=1, max_probes=10).groupBy("query_id").count().filter("count < 20").count() == 0
    graph = hnsw.build(cloud, hnsw.HnswOptions(shard_rows=1000))
    assert recall(hnsw.search(graph, q, 20, ef_search=60)) >= 0.97


def test_index_options_and_empty_tables(spark, cloud):
    with pytest.raises(ValueError):
        ivf.IvfOptions(lists=0)
    with pytest.raises(ValueError):
        hnsw.HnswOptions(m=40, ef_construction=64)
    empty = cloud.limit(0)
    assert ivf.search(ivf.build(empty, ivf.IvfOptions(lists=2)), empty, 3).count() == 0
    assert hnsw.search(hnsw.build(empty), cloud.filter("vec_id = 0"), 3).count() == 0
    assert hnsw.choose_path(100_000, False, lists=100) == "exact" and hnsw.choose_path(100_000, True, lists=100, m=16) in ("ivf", "hnsw")


def test_knn_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, None), (4, [9.0])], "vec_id bigint, embedding array<float>")
    got = knn.knn_batch(df, df.filter("vec_id = 1"), 2, "l2").orderBy("place").collect()
    assert [(r["id"], r["distance"]) for r in got] == [(1, 0.0), (2, 0.0)]
