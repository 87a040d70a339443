"""Queries of the general training-data problems: timestamps and incremental processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators.incremental import process_all, replay_runs
from corvine.operators.timestamps import instants_with_sites
from corvine.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "product_sites")
    pages = instants_with_sites(table(spark, sf_dir, "pages"), sites, "rec_id", "sitemap_lastmod", "pages")
    front = instants_with_sites(table(spark, sf_dir, "frontmatter"), sites, "fm_id", "last_modified", "frontmatter")
    return pages.unionByName(front)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = process_all(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "crawl_runs"))
    return found.select("run_no", "url")


def p7_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all runs in one shuffle, for a table that holds them all."""
    found = replay_runs(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "crawl_runs"))
    return found.select("run_no", "url")


def p5_iso_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found of the texts that SQL can read alone: ISO 8601 with a zone of digits, and seconds or milliseconds."""
    pages = table(spark, sf_dir, "pages").filter(F.col("sitemap_lastmod").rlike(PLAIN_FORM))
    return instants_with_sites(pages, table(spark, sf_dir, "product_sites"), "rec_id", "sitemap_lastmod", "pages")


# ISO 8601 with zone, at most microseconds, or a number alone
PLAIN_FORM = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})|[0-9]{9,14})$"

QUERIES = {"p5_found": p5_found, "p5_iso_epoch": p5_iso_epoch, "p7_found": p7_found, "p7_replay": p7_replay}

HASH = "nullif(trim(regexp_replace(lower(regexp_replace(content_hash, '^\\s+|\\s+$', '', 'g')), '^sha256:\\s*', '')), '')"

P7 = f"""WITH r AS (SELECT run_no FROM crawl_runs WHERE status = 'succeeded'),
 f AS (SELECT url, run_no, fetched_at, {HASH} AS h FROM pages WHERE http_status = 200 AND {HASH} IS NOT NULL),
 c AS (SELECT r.run_no, url, arg_max(h, fetched_at || h) AS h FROM r JOIN f ON f.run_no <= r.run_no GROUP BY ALL),
 d AS (SELECT url, {HASH} AS h FROM documents),
 w AS (SELECT c.*, coalesce(lag(c.h) OVER (PARTITION BY c.url ORDER BY c.run_no), d.h) AS before FROM c LEFT JOIN d ON c.url = d.url)
 SELECT run_no, url FROM w WHERE h IS DISTINCT FROM before"""

ORACLE = {
    "p7_found": P7,
    "p7_replay": P7,
    "p5_iso_epoch": f"""WITH v AS (SELECT rec_id, sitemap_lastmod AS s FROM pages WHERE regexp_matches(sitemap_lastmod, '{PLAIN_FORM}')),
 i AS (SELECT rec_id, CASE WHEN s NOT LIKE '%-%' THEN CAST(s AS BIGINT) * CASE WHEN CAST(s AS BIGINT) < 100000000000 THEN 1000000 ELSE 1000 END ELSE epoch_us(try_cast(s AS TIMESTAMPTZ)) END AS instant_us FROM v)
 SELECT 'pages' AS rec_kind, rec_id, instant_us FROM i WHERE instant_us IS NOT NULL""",
}
