"""Queries over half and sparse types, vector order, joins with nearest neighbours, the run of the indexer, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.functions import half as H
from corvine.functions import sparse
from corvine.functions import vectors as V
from corvine.operators import knn
from corvine.session import once, shared_dir, table

K = 10


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


def _total(c, n: str, digits: int = 4):
    return F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")), digits).alias(n)


def half_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of half vectors, their sums, differences and products, each rounded to half."""
    rows = _rows(spark, sf_dir).select("vec_id", H.half(F.col("embedding"), 64).alias("a"), H.half(F.reverse("embedding")).alias("b"))
    a, b = F.col("a"), F.col("b")
    lead = lambda c: F.slice(c, 1, 20)
    return rows.select(
        "vec_id", _total(lead(a), "plain"), _total(lead(H.half_add(a, b)), "added"), _total(lead(H.half_sub(a, b)), "subtracted"), _total(H.half_mul(a, b), "multiplied", 5),
        _total(lead(H.parse_half(H.format_half(a))), "text_form"), _total(lead(H.receive_half(H.send_half(a))), "binary_form"),
    )


def half_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("label", H.half(F.col("embedding")).alias("h"))
    cells = lambda df, c: df.select("label", F.posexplode(c).alias("pos", c))
    both = cells(H.half_avg(rows, "h", ["label"]), "avg").join(cells(H.half_sum(rows, "h", ["label"]), "sum"), ["label", "pos"])
    return both.select("label", "pos", (F.round(F.col("avg").cast("double"), 6) + 0.0).alias("avg"), (F.round(F.col("sum").cast("double"), 3) + 0.0).alias("sum"))


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.transform("embedding", lambda x: F.when(F.abs(x) < 0.1, F.lit(0.0).cast("float")).otherwise(x))
    return _rows(spark, sf_dir).select("vec_id", H.sparse_of_dims(sparse.from_dense(cut), 64).alias("s"))


def sparse_overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distance, negative inner product and comparisons with the row of id 0, and the binary form."""
    rows = _sparse(spark, sf_dir)
    rows = once(rows, back=H.receive_sparse(H.send_sparse(F.col("s"))))
    q = rows.filter("vec_id = 0").select(F.col("s").alias("q")).limit(1)
    a, b = F.col("s"), F.col("q")
    c = H.sparse_compare(a, b)
    return rows.crossJoin(F.broadcast(q)).select(  # one row
        "vec_id", F.round(H.sparse_l2_squared_distance(a, b), 4).alias("l2_squared"), (F.round(H.sparse_negative_inner_product(a, b), 4) + 0.0).alias("negative_ip"),
        c["lt"].alias("lt"), c["ge"].alias("ge"), c["eq"].alias("eq"), _total(sparse.to_dense(F.col("back")), "binary_form"),
    )


def vectors_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 vectors in the order of vectors: a bounded sort."""
    first = _rows(spark, sf_dir).orderBy("embedding", "vec_id").limit(200)
    return first.select("vec_id", F.row_number().over(W.orderBy("embedding", "vec_id")).alias("place"))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    q = rows.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return rows.crossJoin(F.broadcast(q)).withColumn("distance", F.round(V.l2_distance(F.col("embedding"), F.col("q")), 4))  # one row


def knn_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows up to the tenth distance to one decimal, all its ties included."""
    near = _near(spark, sf_dir).withColumn("distance", F.round("distance", 1))
    tenth = near.orderBy("distance").limit(K).agg(F.max("distance").alias("most"))
    return near.join(F.broadcast(tenth), F.col("distance") <= F.col("most")).select("vec_id", "distance")  # one row


def knn_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors whose document is in English, with its product: the join stands below the order."""
    d = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("vec_id"), "product")
    return _near(spark, sf_dir).join(d, "vec_id").orderBy("distance", "vec_id").limit(K).select("vec_id", "product", "distance")


def knn_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.col("title").like("%the%")).select(F.col("doc_id").alias("vec_id"))
    return _near(spark, sf_dir).join(d, "vec_id", "left_semi").orderBy("distance", "vec_id").limit(K).select("vec_id", "distance")


def knn_fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty nearest first, the filter on them afterwards."""
    inner = _near(spark, sf_dir).orderBy("distance", "vec_id").limit(40)
    return inner.filter("label % 2 = 0").select("vec_id", "label", "distance")


def vectors_copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as text files and read back."""
    path = f"{shared_dir(spark).rstrip('/')}/copy-{uuid.uuid4().hex}"
    _rows(spark, sf_dir).select("vec_id", V.format_vector("embedding").alias("v")).write.csv(path, sep="\t")
    back = spark.read.schema("vec_id bigint, v string").csv(path, sep="\t")
    return back.select("vec_id", _total(F.slice(V.parse_vector("v", 64), 1, 20), "total"))


def vector_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of vectors, one for each hundred ids, and what comes out of them again."""
    grouped = _rows(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 100).alias("part")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("held"))
    again = grouped.select("part", F.size("held").alias("n"), F.explode(F.transform("held", lambda x: x["embedding"])).alias("v"))
    return again.groupBy("part").agg(F.max("n").alias("n"), F.round(F.sum(F.get("v", 0).cast("double")), 4).alias("first_sum"))


def index_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of an indexer run over all header files, by product and version: seen, new, changed, unchanged and to prune."""
    key = ["product", "version"]
    clean = lambda df: df.withColumn("version", F.coalesce("version", F.lit(""))).filter("url is not null")
    files = clean(table(spark, sf_dir, "frontmatter")).groupBy("url").agg(F.max(F.struct("fm_id", "product", "version", "title")).alias("x")).select("url", "x.*")
    held = clean(table(spark, sf_dir, "documents")).select("url", F.col("title").alias("held_title"), F.col("product").alias("held_product"), F.col("version").alias("held_version"))
    both = files.join(held, "url", "full_outer").select(
        F.coalesce("product", "held_product").alias("product"), F.coalesce("version", "held_version").alias("version"),
        F.when(F.col("fm_id").isNull(), "pruned").when(F.col("held_version").isNull(), "indexed").when(~F.col("title").eqNullSafe(F.col("held_title")), "changed").otherwise("unchanged").alias("outcome"),
    )
    count = lambda o: F.count(F.when(F.col("outcome") == o, 1)).alias(o)
    return both.groupBy(*key).agg(*[count(o) for o in ("indexed", "changed", "unchanged", "pruned")])


def crawl_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 50 urls of one run to fetch, in url order."""
    return table(spark, sf_dir, "pages").filter("run_no = 3 and url is not null").select("url").distinct().orderBy("url").limit(50)


QUERIES = {
    "half_arithmetic": half_arithmetic, "half_aggregates": half_aggregates, "sparse_overloads": sparse_overloads, "vectors_in_order": vectors_in_order, "knn_with_ties": knn_with_ties,
    "knn_joined": knn_joined, "knn_like": knn_like, "knn_fenced": knn_fenced, "vectors_copied": vectors_copied, "vector_arrays": vector_arrays, "index_counters": index_counters,
    "crawl_limited": crawl_limited,
}


def _half(x: str) -> str:
    step = f"pow(2.0::DOUBLE, greatest(floor(log2(greatest(abs({x}), 1e-9))), -14) - 10)"
    return f"(round_even(({x}) / {step}, 0) * {step})"


SUM = "list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE)))"
HALVES = f"""h AS (SELECT vec_id, label, list_transform(embedding, lambda x: {_half('CAST(x AS DOUBLE)')}) AS a, list_transform(list_reverse(embedding), lambda x: {_half('CAST(x AS DOUBLE)')}) AS b FROM embeddings)"""
BOTH = "list_transform(list_zip(a, b), lambda p: {0})"
NEAR = """q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
 near AS (SELECT vec_id, label, embedding, round(sqrt(list_sum(list_transform(list_zip(embedding, q), lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2)))), 4) AS distance FROM embeddings, q)"""
CUT = "list_transform(embedding, lambda x: CASE WHEN abs(x) < 0.1::FLOAT THEN 0.0::FLOAT ELSE x END)"

ORACLE = {
    "half_arithmetic": f"""WITH {HALVES} SELECT vec_id, round({SUM.format('a[1:20]')}, 4) AS plain, round({SUM.format(BOTH.format(_half('p[1] + p[2]')) + '[1:20]')}, 4) AS added,
 round({SUM.format(BOTH.format(_half('p[1] - p[2]')) + '[1:20]')}, 4) AS subtracted, round({SUM.format(BOTH.format(_half('p[1] * p[2]')))}, 5) AS multiplied,
 round({SUM.format('a[1:20]')}, 4) AS text_form, round({SUM.format('a[1:20]')}, 4) AS binary_form FROM h""",
    "half_aggregates": f"""WITH {HALVES}, e AS (SELECT label, unnest(range(64)) AS pos, unnest(a) AS x FROM h), s AS (SELECT label, pos, avg(x) AS m, sum(x) AS s FROM e GROUP BY 1, 2)
 SELECT label, CAST(pos AS INTEGER) AS pos, round({_half('CAST(m AS FLOAT)::DOUBLE')}, 6) + 0.0::DOUBLE AS avg, round({_half('CAST(s AS FLOAT)::DOUBLE')}, 3) + 0.0::DOUBLE AS sum FROM s""",
    "sparse_overloads": f"""WITH v AS (SELECT vec_id, {CUT} AS v FROM embeddings), q AS (SELECT v AS q FROM v WHERE vec_id = 0)
 SELECT vec_id, round(list_sum(list_transform(list_zip(v, q), lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))), 4) AS l2_squared,
 round(-list_sum(list_transform(list_zip(v, q), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 4) + 0.0::DOUBLE AS negative_ip, v < q AS lt, v >= q AS ge, v = q AS eq, round({SUM.format('v')}, 4) AS binary_form FROM v, q""",
    "vectors_in_order": "SELECT vec_id, CAST(row_number() OVER (ORDER BY embedding, vec_id) AS INTEGER) AS place FROM embeddings ORDER BY place LIMIT 200",
    "knn_with_ties": f"WITH {NEAR}, r AS (SELECT vec_id, round(distance, 1) AS distance, rank() OVER (ORDER BY round(distance, 1)) AS n FROM near) SELECT vec_id, distance FROM r WHERE n <= {K}",
    "knn_joined": f"WITH {NEAR} SELECT vec_id, product, distance FROM near JOIN documents ON doc_id = vec_id WHERE lang = 'en' ORDER BY distance, vec_id LIMIT {K}",
    "knn_like": f"WITH {NEAR} SELECT vec_id, distance FROM near WHERE vec_id IN (SELECT doc_id FROM documents WHERE title LIKE '%the%') ORDER BY distance, vec_id LIMIT {K}",
    "knn_fenced": f"WITH {NEAR}, i AS MATERIALIZED (SELECT * FROM near ORDER BY distance, vec_id LIMIT 40) SELECT vec_id, label, distance FROM i WHERE label % 2 = 0",
    "vectors_copied": f"SELECT vec_id, round({SUM.format('embedding[1:20]')}, 4) AS total FROM embeddings",
    "vector_arrays": "SELECT CAST(floor(vec_id / 100) AS BIGINT) AS part, CAST(count(*) AS INTEGER) AS n, round(sum(CAST(embedding[1] AS DOUBLE)), 4) AS first_sum FROM embeddings GROUP BY 1",
    "index_counters": """WITH f AS (SELECT url, fm_id, product, coalesce(version, '') AS version, title, row_number() OVER (PARTITION BY url ORDER BY fm_id DESC) AS n FROM frontmatter WHERE url IS NOT NULL),
 b AS (SELECT coalesce(f.product, d.product) AS product, coalesce(f.version, d.version, '') AS version,
  CASE WHEN f.url IS NULL THEN 'pruned' WHEN d.url IS NULL THEN 'indexed' WHEN f.title IS DISTINCT FROM d.title THEN 'changed' ELSE 'unchanged' END AS o
  FROM (SELECT * FROM f WHERE n = 1) f FULL OUTER JOIN documents d ON f.url = d.url)
 SELECT product, version, count(*) FILTER (o = 'indexed') AS indexed, count(*) FILTER (o = 'changed') AS changed, count(*) FILTER (o = 'unchanged') AS unchanged, count(*) FILTER (o = 'pruned') AS pruned FROM b GROUP BY 1, 2""",
    "crawl_limited": "SELECT DISTINCT url FROM pages WHERE run_no = 3 AND url IS NOT NULL ORDER BY url LIMIT 50",
}
