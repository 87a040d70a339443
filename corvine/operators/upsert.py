"""Incremental state of crawled and indexed documents: outcomes, upserts, replacement and pruning as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.functions.docs import parse_version


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Rows of new replace those of old with the same keys; of several new rows the first by order wins.

    One shuffle by the keys; columns missing on one side are null.  Null keys are equal.
    """
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    by = W.partitionBy(*keys).orderBy(F.col("__new").desc(), *([order] if order is not None else []))
    return both.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n", "__new")


def outcomes(parsed: DataFrame, state: DataFrame) -> DataFrame:
    """url and outcome of every parsed document against the stored hash and meta_ok flag.

    'embed' without a stored hash or with another one, 'unchanged' when the derived columns are complete,
    else 'backfill'.
    """
    s = state.select("url", F.col("hash").alias("__hash"), "meta_ok")
    same = F.col("__hash").isNotNull() & F.col("hash").eqNullSafe(F.col("__hash"))
    return parsed.join(s, "url", "left").withColumn(
        "outcome", F.when(~same, "embed").when(F.coalesce("meta_ok", F.lit(False)), "unchanged").otherwise("backfill")
    ).drop("__hash", "meta_ok")


def derived_state(documents: DataFrame, chunks: DataFrame, hash_: Column) -> DataFrame:
    """url, hash, meta_ok: whether the canonical id and all section ids of a stored document are there."""
    lacking = chunks.filter(F.col("section_id").isNull()).select(F.col("document_id").alias("doc_id")).distinct().withColumn("__lacks", F.lit(True))
    return documents.join(lacking, "doc_id", "left").select(
        "url", hash_.alias("hash"), (F.col("__lacks").isNull() & (F.coalesce("canonical_id", F.lit("")) != "")).alias("meta_ok")
    )


def replace_children(old: DataFrame, new: DataFrame, parent: str, changed: DataFrame) -> DataFrame:
    """Children of the changed parents are replaced by the new ones; others stay."""
    return old.join(changed.select(parent).distinct(), parent, "left_anti").unionByName(new)


def cascade(children: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(parent).distinct(), parent, "left_semi")


def prune(documents: DataFrame, live: DataFrame, failures: int = 0) -> DataFrame:
    """Documents without those of a seen product whose url is no longer live; untouched after failures or an empty crawl."""
    if failures or live.isEmpty():
        return documents
    gone = documents.join(live.select("product").distinct(), "product", "left_semi").join(live.select("url").distinct(), "url", "left_anti")
    return documents.join(gone.select("url"), "url", "left_anti")


def latest_patches(rows: DataFrame, product: str = "product", version: str = "version") -> DataFrame:
    """Rows without superseded patches: of versions with three or more parts only the newest per major.minor stays."""
    parts = parse_version(F.col(version))
    competes = F.size(parts) >= 3
    group = F.when(competes, F.slice(parts, 1, 2))
    top = F.max(F.when(competes, parts)).over(W.partitionBy(product, group))
    return rows.withColumn("__top", top).withColumn("__v", parts).filter(
        F.col("__v").isNull() | (F.size("__v") < 3) | (F.col("__v") == F.col("__top"))
    ).drop("__top", "__v")


def scope(entries: DataFrame, prefixes: list[str], exclude: list[str], min_version: str | None = None, url: str = "url", version: str = "version") -> DataFrame:
    """Entries under one of the path prefixes, not excluded by exact url, and of an allowed version."""
    under = F.lit(False)
    for p in prefixes:
        under = under | F.col(url).startswith(p)
    ok = under & ~F.col(url).isin(exclude) if exclude else under
    if min_version is not None:
        least = [int(x) for x in min_version.split(".")]
        v = parse_version(F.col(version))
        ok = ok & (v.isNull() | (v >= F.array(*[F.lit(x) for x in least])))
    return entries.filter(ok)


def to_fetch(entries: DataFrame, state: DataFrame) -> DataFrame:
    """Entries to fetch again: unknown, not 200, without file, or with a missing or another lastmod."""
    s = state.select("url", F.col("http_status").alias("__status"), F.col("file_path").alias("__file"), F.col("sitemap_lastmod").alias("__lastmod"))
    fresh = (F.col("__status") == 200) & F.col("__file").isNotNull() & F.col("lastmod").isNotNull() & (F.col("lastmod") == F.col("__lastmod"))
    return entries.join(s, "url", "left").filter(~F.coalesce(fresh, F.lit(False))).drop("__status", "__file", "__lastmod")


def latest_state(pages: DataFrame) -> DataFrame:
    """The last recorded fetch of every url."""
    by = W.partitionBy("url").orderBy(F.col("fetched_at").desc_nulls_last(), F.col("rec_id").desc())
    return pages.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def crawl_status(state: DataFrame) -> DataFrame:
    """Pages, failed pages and last fetch by product and version."""
    return state.groupBy("product", "version").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.when(F.col("http_status") == 200, 0).otherwise(1)).alias("failed"), F.max("fetched_at").alias("last_fetched")
    )
