"""Queries over the document pipeline, catalogue and search, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions import docs as D
from corvine.functions.analyzers import english_tokens, simple_tokens
from corvine.operators import chunking, upsert
from corvine.operators.incremental import clean_hash
from corvine.plans import search as S
from corvine.plans import tools
from corvine.session import once, table
from corvine.sources.web import extract_articles

SEARCH = "hot volume max_queue_kb"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = F.col("url"), F.coalesce("version", F.lit(""))
    d = D.with_location(_docs(spark, sf_dir).select("doc_id", "url", "title", v.alias("version")), F.col("version"))
    plain = F.filter("rest", lambda s: ~s.rlike(D.PURE_VERSION))
    path = F.coalesce(F.nullif(F.array_join(plain, "/"), F.lit("")), F.lit("index"))
    kept = d.drop("rest", "kept", "loc_manual", "loc_canonical", "seg", "url_product").withColumn("version", F.lit(""))
    again = D.with_location(kept, F.col("version")).select("doc_id", F.array_join(D.aliases_to_try(F.col("loc_canonical"), F.col("seg"), u), " ").alias("aliases"))
    out = d.select(
        "doc_id", D.url_host(u).alias("host"), "url_product", F.coalesce(D.extract_version(u), F.lit("")).alias("url_version"), D.extract_slug(u).alias("slug"),
        F.size("seg").alias("segments"), "loc_manual", "loc_canonical", D.normalize_alias(F.col("title")).alias("title_alias"),
        F.concat_ws("/", "url_product", F.when(F.col("version") == "", "_unversioned").otherwise(F.col("version")), F.concat(path, F.lit(".md"))).alias("file_path"),
    )
    return out.join(again, "doc_id")


def keys_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(
        "doc_id", D.document_key(F.col("url")).alias("doc_key"), F.sha2(F.concat(F.coalesce("title", F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))), 256).alias("body_hash"),
        D.crawl_hash(F.coalesce("text", F.lit(""))).alias("crawl_hash"), D.anchor_slug(F.col("title")).alias("title_anchor"), D.rfc3339(F.col("updated_at")).alias("updated"),
        F.length(D.embed_input(F.col("title"), F.col("breadcrumb"), F.col("text"))).alias("embed_chars"), F.size(F.split("breadcrumb", " > ")).alias("crumbs"),
    )


def version_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of every version within its product, newest first, unversioned last."""
    from pyspark.sql import Window as W

    v = _docs(spark, sf_dir).select("product", F.coalesce("version", F.lit("")).alias("version")).distinct()
    by = W.partitionBy("product").orderBy(D.parse_version(F.col("version")).desc_nulls_last(), "version")
    return v.select("product", "version", F.row_number().over(by).alias("place"))


def latest_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.latest_patches(_docs(spark, sf_dir).select("doc_id", "product", "version")).select("doc_id", "product", "version")


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(_docs(spark, sf_dir))


def section_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "url")
    chunks = table(spark, sf_dir, "chunks").select("id", "document_id", "chunk_index", "heading")
    # a section ingested again keeps its place, so the id settles the order
    once = chunks.groupBy("document_id", "chunk_index").agg(F.min(F.struct("id", "heading")).alias("x")).select("document_id", "chunk_index", "x.*")
    return chunking.with_section_ids(once.join(d, "document_id"), "document_id").select("document_id", "chunk_index", "anchor", "section_id")


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.latest_state(table(spark, sf_dir, "pages"))


def incremental_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _state(spark, sf_dir).select("url", clean_hash(F.col("content_hash")).alias("hash"))
    stored = upsert.derived_state(_docs(spark, sf_dir), table(spark, sf_dir, "chunks"), clean_hash(F.col("content_hash")))
    return upsert.outcomes(parsed, stored).select("url", "outcome")


def prune_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _state(spark, sf_dir).filter("http_status = 200").select("product", "url")
    docs = upsert.prune(_docs(spark, sf_dir).select("doc_id", "url", "product"), live)
    gone = _docs(spark, sf_dir).join(docs.select("doc_id"), "doc_id", "left_anti")
    kept_chunks = upsert.cascade(table(spark, sf_dir, "chunks").select("id", F.col("document_id").alias("doc_id")), docs, "doc_id").groupBy("doc_id").count()
    return docs.join(kept_chunks, "doc_id", "left").select("doc_id", F.coalesce("count", F.lit(0)).cast("bigint").alias("n_chunks"), F.lit(False).alias("pruned")).unionByName(
        gone.select("doc_id", F.lit(0).cast("bigint").alias("n_chunks"), F.lit(True).alias("pruned"))
    )


def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the first six runs brought up to date with the others, newest fetch first."""
    pages = table(spark, sf_dir, "pages").select("rec_id", "run_no", "url", "http_status", "fetched_at")
    old = upsert.latest_state(pages.filter("run_no <= 6"))
    merged = upsert.upsert(old, pages.filter("run_no > 6"), ["url"], F.struct(F.col("fetched_at"), F.col("rec_id")).desc())
    return merged.select("url", "rec_id", "run_no")


def crawl_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.crawl_status(_state(spark, sf_dir)).withColumn("version", F.coalesce("version", F.lit("")))


def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _state(spark, sf_dir).select("url", "version")
    return upsert.scope(entries, ["https://help.quarrydocs.example/en/quarry-core", "https://dev.tallowdocs.example/en/"], [], "9.1").select("url")


def fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sitemap as of run 11 asks to fetch again, given the state after run 10, by product."""
    pages = table(spark, sf_dir, "pages")
    entries = upsert.latest_state(pages.filter("run_no = 11")).select("url", "product", F.col("sitemap_lastmod").alias("lastmod"))
    return upsert.to_fetch(entries, upsert.latest_state(pages.filter("run_no <= 10"))).groupBy("product").agg(F.count(F.lit(1)).alias("to_fetch"))


def docsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tools.docset_versions(_docs(spark, sf_dir), manuals=True)
    return d.withColumn("manuals", F.array_join("manuals", ",")).withColumn("version", F.coalesce("version", F.lit("")))


def docsets_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tools.docsets(_docs(spark, sf_dir))
    return d.select("product", "pages", F.coalesce("latest", F.lit("")).alias("latest"), F.array_join(F.transform("versions", lambda v: F.concat(F.coalesce(v["version"], F.lit("")), F.lit(":"), v["pages"].cast("string"))), ",").alias("versions"))


def section_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tools.section_context(table(spark, sf_dir, "chunks"), 2, 1)
    heads = lambda c: F.array_join(F.transform(c, lambda x: x["heading"]), "|")
    return s.select("id", "document_id", heads("before").alias("before_headings"), heads("after").alias("after_headings"))


def page_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.pages(table(spark, sf_dir, "chunks"), _docs(spark, sf_dir)).select("doc_id", F.md5("page").alias("page_md5"), F.length("page").alias("chars"))


def document_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.aliases(_docs(spark, sf_dir))


def resolve_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every crawled url resolved to a stored page, by itself or by its aliases."""
    u = F.col("url")
    urls = table(spark, sf_dir, "pages").select("url").distinct().withColumn("version", F.lit(""))
    wanted = D.with_location(urls, F.col("version")).select("url", D.aliases_to_try(F.col("loc_canonical"), F.col("seg"), u).alias("tries"))
    return tools.resolve(wanted, _docs(spark, sf_dir)).select("url", "resolved_id", "by_alias")


def compare_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks")
    return tools.compare_documents(chunks, tools.version_pairs(_docs(spark, sf_dir)), diffs=False).withColumn("place", F.col("place").cast("bigint"))


def compare_versions_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.compare_documents(table(spark, sf_dir, "chunks"), tools.version_pairs(_docs(spark, sf_dir)))


def lexemes_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return once(table(spark, sf_dir, "chunks").select("id", "content"), t=simple_tokens(F.col("content"))).select("id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_lexemes"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def lexemes_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("id", F.array_join(english_tokens("content"), " ").alias("lexemes"))


def _args(spark: SparkSession, sf_dir: str, **more) -> S.SearchArgs:
    return S.SearchArgs(SEARCH, max_results=20, **more)


def search_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search with the plain analyzer and without a semantic leg, which SQL can express."""
    found = S.search(table(spark, sf_dir, "chunks"), _docs(spark, sf_dir), _args(spark, sf_dir, analyzer="simple"), snippets=False)
    return found.select("rank", "id", F.round("score", 6).alias("score"), F.array_join("match_types", ",").alias("match_types"))


def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = _args(spark, sf_dir, query_vector=S.hashed_embedding(SEARCH))
    return S.search(table(spark, sf_dir, "chunks"), _docs(spark, sf_dir), args).withColumn("match_types", F.array_join("match_types", ","))


def search_latest_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = _args(spark, sf_dir, mode="conceptual", product="quarry-core", latest_only=True, query_vector=S.hashed_embedding(SEARCH))
    return S.search(table(spark, sf_dir, "chunks"), _docs(spark, sf_dir), args).withColumn("match_types", F.array_join("match_types", ","))


def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(table(spark, sf_dir, "page_content"))


QUERIES = {
    "url_parts": url_parts, "keys_and_hashes": keys_and_hashes, "version_sort": version_sort, "latest_patch": latest_patch, "chunk_documents": chunk_documents, "section_ids": section_ids,
    "incremental_outcomes": incremental_outcomes, "prune_stale": prune_stale, "state_upsert": state_upsert, "crawl_status": crawl_status, "scope_filter": scope_filter, "fetch_plan": fetch_plan,
    "docsets": docsets, "docsets_nested": docsets_nested, "section_context": section_context, "page_reassembly": page_reassembly, "document_aliases": document_aliases,
    "resolve_urls": resolve_urls, "compare_versions": compare_versions, "compare_versions_diff": compare_versions_diff, "lexemes_simple": lexemes_simple, "lexemes_english": lexemes_english,
    "search_simple": search_simple, "search_hybrid": search_hybrid, "search_latest_filtered": search_latest_filtered, "extract_pages": extract_pages,
}

# SQL of the queries

VER = "CASE WHEN regexp_full_match({0}, '[0-9]+(\\.[0-9]+)+') THEN list_transform(string_split({0}, '.'), lambda x: CAST(x AS INTEGER)) END"
SEG = "list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')"
ALIAS = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
RID = "regexp_extract(url, '[?&]resourceId=([^&#]*)', 1)"
SLUG = f"CASE WHEN {RID} <> '' THEN string_split({RID}, '_')[-1] ELSE seg[len(seg)] END"
HASH = "nullif(trim(regexp_replace(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '^sha256:\\s*', '')), '')"
STATE = "state AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, rec_id DESC) AS n FROM pages) WHERE n = 1)"
ANCHOR = (
    "CASE WHEN coalesce({0}, '') = '' THEN 'overview' WHEN regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = '' THEN 'section'"
    " ELSE regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END"
)
PLACED = f"""p AS (SELECT doc_id, url, coalesce(version, '') AS version, {SEG} AS seg FROM documents),
 s AS (SELECT *, seg[2] AS product, seg[3:] AS rest FROM p),
 m AS (SELECT *, coalesce(list_position(list_transform(rest, lambda x: (version <> '' AND x = version) OR regexp_full_match(x, 'latest|[0-9]+(\\.[0-9]+)*')), TRUE), 0) AS vp FROM s),
 k AS (SELECT *, CASE WHEN vp > 0 THEN list_concat(rest[1:vp - 1], rest[vp + 1:]) ELSE rest END AS kept FROM m),
 w AS (SELECT *, coalesce(list_position(list_transform(rest, lambda x: regexp_full_match(x, 'latest|[0-9]+(\\.[0-9]+)*')), TRUE), 0) AS vp0 FROM k),
 l AS (SELECT *, CASE WHEN vp0 > 0 THEN list_concat(rest[1:vp0 - 1], rest[vp0 + 1:]) ELSE rest END AS kept0 FROM w)"""
TOK = "list_filter(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9_./:-]+'), lambda t: regexp_replace(t, '^[./:-]+|[./:-]+$', '', 'g')), lambda t: t <> '')"
ALIASES = f"""al AS (SELECT DISTINCT alias, doc_id FROM (
  SELECT 'slug:' || {ALIAS.format('seg[len(seg)]')} AS alias, doc_id FROM (SELECT doc_id, {SEG} AS seg FROM documents) WHERE {ALIAS.format('seg[len(seg)]')} <> ''
  UNION ALL SELECT 'path:' || {ALIAS.format('canonical_id')}, doc_id FROM documents WHERE {ALIAS.format("coalesce(canonical_id, '')")} <> ''))"""


def _count(c: str, t: str) -> str:
    return f"len(list_filter({c}, lambda t: t = '{t}'))"


def _search_sql(text: str, limit: int = 20) -> str:
    terms, ids = text.split(), D.identifier_tokens(text)
    sw, bw, ew, _ = D.leg_weights("auto", bool(ids))
    total = lambda ts: " + ".join(f"(1.0::DOUBLE * {_count('tt', t)} + 0.4::DOUBLE * {_count('th', t)} + 0.1::DOUBLE * {_count('tc', t)})" for t in ts)
    hit = lambda t: f"({_count('tt', t)} + {_count('th', t)} + {_count('tc', t)} > 0)"
    legs = [("keyword", sw, terms, " AND "), ("partial", bw, terms, " OR "), ("identifier", ew, ids, " OR ")]
    parts = " UNION ALL ".join(
        f"SELECT id, '{n}' AS leg, {w}::DOUBLE / ({S.RRF_K} + row_number() OVER (ORDER BY round(r / (r + 1), 9) DESC, id)) AS w FROM (SELECT id, {total(ts)} AS r FROM sec"
        f" WHERE {j.join(hit(t) for t in ts)} ORDER BY round(r / (r + 1), 9) DESC, id LIMIT {S.POOL})"
        for n, w, ts, j in legs
    )
    inside = lambda c: " AND ".join(f"{_count(c, t)} > 0" for t in terms)
    return f"""WITH sec AS (SELECT c.id, c.section_id, c.heading, d.version, d.canonical_id, {TOK.format('d.title')} AS tt, {TOK.format('c.heading')} AS th, {TOK.format('c.content')} AS tc
  FROM chunks c JOIN documents d ON c.document_id = d.doc_id),
 fused AS (SELECT id, sum(w) AS score, list_sort(list_distinct(list(leg))) AS legs FROM ({parts}) GROUP BY id),
 scored AS (SELECT sec.*, score + CASE WHEN {inside('tt')} THEN {S.TITLE_BONUS}::DOUBLE ELSE 0 END + CASE WHEN {inside('th')} THEN {S.HEADING_BONUS}::DOUBLE ELSE 0 END AS score,
  list_sort(list_concat(legs, CASE WHEN {inside('tt')} THEN ['title'] ELSE [] END, CASE WHEN {inside('th')} THEN ['heading'] ELSE [] END)) AS mt FROM sec JOIN fused USING (id)),
 one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id, coalesce(nullif(split_part(section_id, '#', 2), ''), lower(heading)), coalesce(version, '')
  ORDER BY {VER.format('version')} DESC NULLS LAST, round(score, 9) DESC, id) AS n1 FROM scored) WHERE n1 = 1),
 two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY round(score, 9) DESC, id) AS n2 FROM one) WHERE n2 <= {S.PER_PAGE}),
 top AS (SELECT * FROM two ORDER BY round(score, 9) DESC, id LIMIT {limit})
SELECT CAST(row_number() OVER (ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, id, round(score, 6) AS score, array_to_string(mt, ',') AS match_types FROM top"""


ORACLE = {
    "url_parts": f"""WITH {PLACED} SELECT doc_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS host, product AS url_product,
 coalesce(nullif(list_filter(list_transform(seg, lambda x: regexp_extract(x, '^([0-9]+(?:\\.[0-9]+)+)(?:-|$)', 1)), lambda x: x <> '')[-1], ''), '') AS url_version,
 {SLUG} AS slug, CAST(len(seg) AS INTEGER) AS segments, CASE WHEN len(kept) = 0 THEN '' WHEN vp > 1 THEN rest[vp - 1] ELSE kept[1] END AS loc_manual,
 CASE WHEN len(kept) = 0 THEN '' ELSE lower(product || '/' || array_to_string(kept, '/')) END AS loc_canonical,
 (SELECT {ALIAS.format('d.title')} FROM documents d WHERE d.doc_id = l.doc_id) AS title_alias,
 product || '/' || CASE WHEN version = '' THEN '_unversioned' ELSE version END || '/' || coalesce(nullif(array_to_string(list_filter(rest, lambda x: NOT regexp_full_match(x, '[0-9]+(\\.[0-9]+)+')), '/'), ''), 'index') || '.md' AS file_path,
 CASE WHEN {RID} <> '' THEN '' ELSE 'path:' || {ALIAS.format("product || '/' || array_to_string(kept0, '/')")} || ' ' END || 'slug:' || {ALIAS.format(SLUG)} AS aliases FROM l""",
    "keys_and_hashes": f"""SELECT doc_id, substr(sha256(url), 1, 16) AS doc_key, sha256(coalesce(title, '') || '|' || coalesce(text, '')) AS body_hash, 'sha256:' || sha256(coalesce(text, '')) AS crawl_hash,
 {ANCHOR.format('title')} AS title_anchor, strftime(updated_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS updated,
 CAST(length('search_document: ' || coalesce(title, '') || CASE WHEN coalesce(breadcrumb, '') <> '' THEN ' > ' || breadcrumb ELSE '' END || chr(10) || coalesce(text, '')) AS INTEGER) AS embed_chars,
 CAST(len(string_split(breadcrumb, ' > ')) AS INTEGER) AS crumbs FROM documents""",
    "version_sort": f"WITH v AS (SELECT DISTINCT product, coalesce(version, '') AS version FROM documents) SELECT product, version, CAST(row_number() OVER (PARTITION BY product ORDER BY {VER.format('version')} DESC NULLS LAST, version) AS INTEGER) AS place FROM v",
    "latest_patch": f"WITH v AS (SELECT doc_id, product, version, {VER.format('version')} AS p FROM documents), t AS (SELECT product, p[1:2] AS g, max(p) AS top FROM v WHERE len(p) >= 3 GROUP BY 1, 2)"
    " SELECT doc_id, v.product, version FROM v LEFT JOIN t ON v.product = t.product AND v.p[1:2] = t.g WHERE p IS NULL OR len(p) < 3 OR p = top",
    "chunk_documents": """WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents WHERE text <> ''),
 f AS (SELECT *, CASE WHEN starts_with(ltrim(line, ' ' || chr(9)), '```') THEN 1 ELSE 0 END AS tick FROM ln),
 g AS (SELECT *, sum(tick) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AS fence FROM f),
 h AS (SELECT *, tick = 0 AND NOT fence AND regexp_full_match(line, '#{2,3}\\s+.+') AS head FROM g),
 k AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM h),
 c AS (SELECT doc_id, grp, coalesce(max(CASE WHEN head THEN regexp_replace(regexp_extract(line, '^#{2,3}\\s+(.+)$', 1), '^\\s+|\\s+$', '', 'g') END), '') AS heading,
  coalesce(max(CASE WHEN head THEN length(regexp_extract(line, '^(#+)', 1)) END), 0) AS level,
  regexp_replace(string_agg(line, chr(10) ORDER BY n) FILTER (NOT head AND NOT (tick = 0 AND NOT fence AND grp = 0 AND regexp_matches(line, '^#\\s'))), '^\\s+|\\s+$', '', 'g') AS content FROM k GROUP BY doc_id, grp)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INTEGER) AS chunk_index, heading, CAST(level AS SMALLINT) AS heading_level, content FROM c WHERE content <> ''""",
    "section_ids": f"""WITH o AS (SELECT document_id, chunk_index, arg_min(struct_pack(h := heading), id).h AS heading FROM chunks GROUP BY 1, 2),
 a AS (SELECT o.*, url, {ANCHOR.format('heading')} AS anchor FROM o JOIN documents d ON o.document_id = d.doc_id),
 n AS (SELECT *, row_number() OVER (PARTITION BY document_id, anchor ORDER BY chunk_index) AS k FROM a)
 SELECT document_id, chunk_index, anchor, substr(sha256(url), 1, 16) || '#' || anchor || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS section_id FROM n""",
    "incremental_outcomes": f"""WITH {STATE}, s AS (SELECT url, {HASH.format('content_hash')} AS h, coalesce(canonical_id, '') <> '' AND doc_id NOT IN (SELECT document_id FROM chunks WHERE section_id IS NULL AND document_id IS NOT NULL) AS ok FROM documents)
 SELECT state.url, CASE WHEN s.h IS NULL OR {HASH.format('state.content_hash')} IS DISTINCT FROM s.h THEN 'embed' WHEN s.ok THEN 'unchanged' ELSE 'backfill' END AS outcome FROM state LEFT JOIN s ON state.url = s.url""",
    "prune_stale": f"""WITH {STATE}, live AS (SELECT product, url FROM state WHERE http_status = 200),
 d AS (SELECT doc_id, product IN (SELECT product FROM live) AND url NOT IN (SELECT url FROM live) AS pruned FROM documents)
 SELECT doc_id, CAST(CASE WHEN pruned THEN 0 ELSE (SELECT count(*) FROM chunks c WHERE c.document_id = d.doc_id) END AS BIGINT) AS n_chunks, pruned FROM d""",
    "state_upsert": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY run_no > 6 DESC, fetched_at DESC NULLS LAST, rec_id DESC) AS n FROM pages) SELECT url, rec_id, run_no FROM a WHERE n = 1""",
    "crawl_status": f"WITH {STATE} SELECT product, coalesce(version, '') AS version, count(*) AS pages, CAST(sum(CASE WHEN http_status = 200 THEN 0 ELSE 1 END) AS BIGINT) AS failed, max(fetched_at) AS last_fetched FROM state GROUP BY product, version",
    "scope_filter": f"WITH {STATE} SELECT url FROM state WHERE (starts_with(url, 'https://help.quarrydocs.example/en/quarry-core') OR starts_with(url, 'https://dev.tallowdocs.example/en/')) AND (({VER.format('version')}) IS NULL OR ({VER.format('version')}) >= [9, 1])",
    "fetch_plan": """WITH e AS (SELECT url, product, sitemap_lastmod AS lastmod FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, rec_id DESC) AS n FROM pages WHERE run_no = 11) WHERE n = 1),
 s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, rec_id DESC) AS n FROM pages WHERE run_no <= 10) WHERE n = 1)
 SELECT e.product, count(*) AS to_fetch FROM e LEFT JOIN s ON e.url = s.url WHERE NOT coalesce(s.http_status = 200 AND s.file_path IS NOT NULL AND lastmod IS NOT NULL AND lastmod = s.sitemap_lastmod, FALSE) GROUP BY e.product""",
    "docsets": """SELECT product, coalesce(version, '') AS version, count(*) AS pages, strftime(max(source_updated_at) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS source_updated,
 strftime(max(updated_at) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS indexed_at, coalesce(array_to_string(list_sort(list_distinct(list(manual) FILTER (manual <> ''))), ','), '') AS manuals FROM documents GROUP BY product, version""",
    "docsets_nested": f"""WITH v AS (SELECT product, version, count(*) AS pages FROM documents GROUP BY 1, 2),
 n AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY {VER.format('version')} DESC NULLS LAST, version DESC NULLS LAST) AS k FROM v)
 SELECT product, CAST(sum(pages) AS BIGINT) AS pages, coalesce(max(CASE WHEN k = 1 THEN version END), '') AS latest, string_agg(coalesce(version, '') || ':' || pages, ',' ORDER BY k) AS versions FROM n GROUP BY product""",
    "section_context": """SELECT id, document_id, coalesce(array_to_string(list(coalesce(heading, '')) OVER (PARTITION BY document_id ORDER BY chunk_index, id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '|'), '') AS before_headings,
 coalesce(array_to_string(list(coalesce(heading, '')) OVER (PARTITION BY document_id ORDER BY chunk_index, id ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), '|'), '') AS after_headings FROM chunks""",
    "page_reassembly": """WITH b AS (SELECT document_id, string_agg(CASE WHEN coalesce(heading, '') <> '' THEN repeat('#', CASE WHEN heading_level BETWEEN 2 AND 6 THEN heading_level ELSE 2 END) || ' ' || heading || chr(10) ELSE '' END || coalesce(content, '') || chr(10), chr(10) ORDER BY chunk_index, id) AS body FROM chunks GROUP BY 1),
 p AS (SELECT doc_id, '# ' || coalesce(title, '') || chr(10) || CASE WHEN coalesce(breadcrumb, '') <> '' THEN breadcrumb || chr(10) ELSE '' END || chr(10) || body AS page FROM documents d JOIN b ON d.doc_id = b.document_id)
 SELECT doc_id, md5(page) AS page_md5, CAST(length(page) AS INTEGER) AS chars FROM p""",
    "document_aliases": f"WITH {ALIASES} SELECT alias, doc_id FROM al",
    "resolve_urls": f"""WITH {ALIASES}, u AS (SELECT DISTINCT url FROM pages), p AS (SELECT url, {SEG} AS seg FROM u), s AS (SELECT *, seg[2] AS product, seg[3:] AS rest FROM p),
 w AS (SELECT *, coalesce(list_position(list_transform(rest, lambda x: regexp_full_match(x, 'latest|[0-9]+(\\.[0-9]+)*')), TRUE), 0) AS vp FROM s),
 k AS (SELECT *, CASE WHEN vp > 0 THEN list_concat(rest[1:vp - 1], rest[vp + 1:]) ELSE rest END AS kept FROM w),
 t AS (SELECT url, 0 AS turn, 'path:' || {ALIAS.format("product || '/' || array_to_string(kept, '/')")} AS alias FROM k WHERE len(kept) > 0 UNION ALL SELECT url, 1, 'slug:' || {ALIAS.format('seg[len(seg)]')} FROM k WHERE {ALIAS.format('seg[len(seg)]')} <> ''),
 h AS (SELECT t.url, al.doc_id, row_number() OVER (PARTITION BY t.url ORDER BY turn, {VER.format('d.version')} DESC NULLS LAST, length(d.url), al.doc_id) AS n FROM t JOIN al USING (alias) JOIN documents d ON d.doc_id = al.doc_id)
 SELECT u.url, coalesce(d.doc_id, h.doc_id) AS resolved_id, d.doc_id IS NULL AS by_alias FROM u LEFT JOIN documents d ON d.url = u.url LEFT JOIN h ON h.url = u.url AND h.n = 1""",
    "compare_versions": f"""WITH v AS (SELECT canonical_id AS pair, doc_id, row_number() OVER (PARTITION BY canonical_id ORDER BY {VER.format('version')} DESC, doc_id) AS n, lead(doc_id) OVER (PARTITION BY canonical_id ORDER BY {VER.format('version')} DESC, doc_id) AS old_id
  FROM documents WHERE coalesce(canonical_id, '') <> '' AND ({VER.format('version')}) IS NOT NULL), p AS (SELECT pair, old_id, doc_id AS new_id FROM v WHERE n = 1 AND old_id IS NOT NULL),
 c AS (SELECT document_id, lower(coalesce(heading, '')) AS low, coalesce(content, '') AS content, chunk_index, id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id) - 1 AS place,
  row_number() OVER (PARTITION BY document_id, lower(coalesce(heading, '')) ORDER BY chunk_index, id) AS k FROM chunks),
 s AS (SELECT document_id, low || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS section_key, content, place FROM c),
 o AS (SELECT pair, section_key, content, place FROM p JOIN s ON s.document_id = p.old_id), w AS (SELECT pair, section_key, content, place FROM p JOIN s ON s.document_id = p.new_id)
 SELECT coalesce(o.pair, w.pair) AS pair, coalesce(o.section_key, w.section_key) AS section_key, CASE WHEN o.content IS NULL THEN 'added' WHEN w.content IS NULL THEN 'removed' ELSE 'modified' END AS status,
 CAST(coalesce(w.place, 2 * o.place + 1) AS BIGINT) AS place FROM o FULL OUTER JOIN w ON o.pair = w.pair AND o.section_key = w.section_key WHERE o.content IS DISTINCT FROM w.content""",
    "lexemes_simple": f"WITH t AS (SELECT id, {TOK.format('content')} AS t FROM chunks) SELECT id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_lexemes, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t",
    "search_simple": _search_sql(SEARCH),
}
