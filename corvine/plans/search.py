"""Hybrid search over sections: four ranked legs, reciprocal-rank fusion, version collapse, page diversity."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.functions.analyzers import english_lexemes, english_tokens, simple_tokens, stem
from corvine.functions.docs import citation_url, identifier_tokens, leg_weights, merge_filters, parse_version, section_key
from corvine.functions.vectors import cosine_distance
from corvine.session import materialize, once

POOL = 60
RRF_K = 60
PER_PAGE = 2
TITLE_BONUS, HEADING_BONUS = 0.010, 0.005
# How much a hit in title, heading and content counts.
FIELD_WEIGHTS = {"title": 1.0, "heading": 0.4, "content": 0.1}
MAX_RESULTS, DEFAULT_RESULTS = 20, 5


@dataclass(frozen=True)
class SearchArgs:
    query: str
    product: str | None = None
    products: list[str] = field(default_factory=list)
    version: str | None = None
    versions: list[str] = field(default_factory=list)
    manual: str | None = None
    manuals: list[str] = field(default_factory=list)
    mode: str = "auto"
    latest_only: bool = False
    max_results: int = DEFAULT_RESULTS
    query_vector: list[float] | None = None
    analyzer: str = "english"
    """Analyzer of the strict and broad legs: english or simple."""


def sections(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Sections with the columns of their page that search needs."""
    d = documents.select("doc_id", "url", "title", "product", "version", "manual", "canonical_id", "breadcrumb", "source_updated_at")
    return chunks.join(d, chunks["document_id"] == d["doc_id"]).drop("doc_id")


def filtered(rows: DataFrame, args: SearchArgs) -> DataFrame:
    """List filters apply only when they are given; they stand below every leg's limit."""
    for c, one, many in (("product", args.product, args.products), ("version", args.version, args.versions), ("manual", args.manual, args.manuals)):
        if values := merge_filters(one, many):
            rows = rows.filter(F.col(c).isin(values))
    return rows


def require_products(documents: DataFrame, wanted: list[str]) -> None:
    """An unknown product is an error that lists the known ones."""
    if wanted:
        known = {r[0] for r in documents.filter(F.col("product").isin(wanted)).select("product").distinct().collect()}
        if lacking := [p for p in wanted if p not in known]:
            valid = sorted(r[0] for r in documents.select("product").distinct().limit(1000).collect() if r[0])
            raise ValueError(f"unknown product {lacking[0]}; valid: {', '.join(valid)}")


def parse_web_query(text: str) -> list[list[str]]:
    """AND of OR groups: words joined by OR form one group; quotes only delimit."""
    groups: list[list[str]] = []
    join = False
    for w in text.replace('"', " ").split():
        if w == "OR":
            join = bool(groups)
        elif join:
            groups[-1].append(w)
            join = False
        else:
            groups.append([w])
    return groups


def _lexemes(word: str, analyzer: str) -> list[str]:
    if analyzer == "english":
        return english_lexemes(word)
    found = [t.strip("./:-") for t in re.findall(r"[a-z0-9_./:-]+", word.lower())]
    return [t for t in found if t]


def tokens(analyzer: str, c: str) -> Column:
    return english_tokens(F.coalesce(F.col(c), F.lit(""))) if analyzer == "english" else simple_tokens(F.col(c))


def with_tokens(rows: DataFrame, analyzer: str, prefix: str) -> DataFrame:
    columns = {f"{prefix}{f}": tokens(analyzer, f) for f in FIELD_WEIGHTS}
    return once(rows, **columns) if analyzer == "simple" else rows.withColumns(columns)


def term_count(prefix: str, name: str, lexeme: str) -> Column:
    return F.size(F.filter(F.col(prefix + name), lambda t: t == lexeme))


def lexical_score(groups: list[list[str]], prefix: str, require_all: bool) -> Column:
    """Weighted term frequency r / (r + 1) where the groups match, else null.

    A group matches when one of its terms stands in any field; all groups must match, or any.
    """
    if not groups:
        return F.lit(None).cast("double")
    total, matches = F.lit(0.0), []
    for group in groups:
        hits = F.lit(0)
        for lexeme in group:
            for name, weight in FIELD_WEIGHTS.items():
                n = term_count(prefix, name, lexeme)
                hits = hits + n
                total = total + n * weight
        matches.append(hits > 0)
    ok = matches[0]
    for m in matches[1:]:
        ok = ok & m if require_all else ok | m
    return F.when(ok, total / (total + 1))


def analysed(text: str, analyzer: str) -> list[list[str]]:
    groups = [[x for w in g for x in _lexemes(w, analyzer)] for g in parse_web_query(text)]
    return [list(dict.fromkeys(g)) for g in groups if g]


def leg(rows: DataFrame, score: Column, name: str) -> DataFrame:
    """id, leg, rank of the POOL best rows: a bounded sort, then a window over at most POOL rows."""
    best = rows.select("id", score.alias("s")).filter("s is not null").orderBy(F.round("s", 9).desc(), "id").limit(POOL)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.round("s", 9).desc(), "id"))).select("id", F.lit(name).alias("leg"), "rank")


def legs(rows: DataFrame, args: SearchArgs) -> tuple[DataFrame, list[list[str]]]:
    """Union of the legs with a weight and something to match, and the strict query's groups."""
    ids = identifier_tokens(args.query)
    strict_w, broad_w, exact_w, semantic_w = leg_weights(args.mode, bool(ids))
    strict = analysed(args.query, args.analyzer)
    parts: list[tuple[DataFrame, float]] = []
    if strict and (strict_w > 0 or broad_w > 0):
        # both legs from one pass over the text: what matches all terms also matches some
        plain = with_tokens(rows.select("id", *FIELD_WEIGHTS), args.analyzer, "__t_")
        scores = plain.select("id", lexical_score(strict, "__t_", True).alias("k"), lexical_score(strict, "__t_", False).alias("p"))
        scores = materialize(scores.filter("p is not null"), "scores")
        if strict_w > 0:
            parts.append((leg(scores, F.col("k"), "keyword"), strict_w))
        if broad_w > 0:
            parts.append((leg(scores, F.col("p"), "partial"), broad_w))
    exact = analysed(" OR ".join(ids), "simple") if ids else analysed(args.query, "simple")
    if exact_w > 0 and exact:
        parts.append((leg(with_tokens(rows, "simple", "__e_"), lexical_score(exact, "__e_", True), "identifier"), exact_w))
    if semantic_w > 0 and args.query_vector is not None:
        q = F.array(*[F.lit(float(x)).cast("float") for x in args.query_vector])
        same = rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") == len(args.query_vector)))
        d = cosine_distance(F.col("embedding"), q)
        parts.append((leg(same.withColumn("__d", d).filter(~F.isnan("__d")), 1 - F.col("__d"), "semantic"), semantic_w))
    out = None
    for df, w in parts:
        df = df.withColumn("w", F.lit(w) / (F.lit(RRF_K) + F.col("rank")))
        out = df if out is None else out.unionByName(df)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "id bigint, leg string, rank int, w double")
    return out, strict


def fuse(ranked: DataFrame) -> DataFrame:
    """id, score, legs: summed reciprocal ranks and the sorted names of the legs."""
    return ranked.groupBy("id").agg(F.sum("w").alias("score"), F.array_sort(F.collect_set(F.when(F.col("w") > 0, F.col("leg")))).alias("legs"))


def collapse(rows: DataFrame, latest_only: bool) -> DataFrame:
    """One row per page, section and (unless latest_only) version: the newest version, then the best score."""
    key = section_key(F.col("section_id"), F.col("heading"))
    version = F.lit("") if latest_only else F.coalesce("version", F.lit(""))
    by = W.partitionBy("canonical_id", key, version).orderBy(parse_version(F.col("version")).desc_nulls_last(), F.round("score", 9).desc(), "id")
    return rows.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def diversify(rows: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    by = W.partitionBy("canonical_id").orderBy(F.round("score", 9).desc(), "id")
    return rows.withColumn("__n", F.row_number().over(by)).filter(F.col("__n") <= per_page).drop("__n")


def _fragments(text: str, terms: set[str], lexeme, fragments: int = 3, words: int = 50) -> str:
    """Best fragments of at most ``words`` words around the terms, marked with **."""
    parts = text.split()
    hits = [k for k, w in enumerate(parts) if any(x in terms for x in lexeme(w))]
    if not hits:
        return " ".join(parts[:words])
    out, free = [], list(hits)
    while free and len(out) < fragments:
        start = max(free, key=lambda s: (sum(s <= h < s + words for h in free), -s))
        a = max(0, start - 5)
        b = min(len(parts), a + words)
        if all(b <= x or a >= y for x, y in out):
            out.append((a, b))
        free = [h for h in free if not a <= h < b]
    marked = lambda k: f"**{parts[k]}**" if k in hits else parts[k]
    return " … ".join(" ".join(marked(k) for k in range(a, b)) for a, b in sorted(out))


def headline(column: Column, terms: list[str], analyzer: str) -> Column:
    """Marked fragments of a text for a set of lexemes."""
    wanted = set(terms)

    @F.pandas_udf("string")
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _fragments(t, wanted, lambda w: _lexemes(w, analyzer)))

    return make(column)


def search(chunks: DataFrame, documents: DataFrame, args: SearchArgs, snippets: bool = True) -> DataFrame:
    """Ranked sections of a query: rank, id, score, match_types, citation_url and page columns, snippet.

    Filters apply inside every leg.  The strict query in title or heading adds a bonus and its name to
    the provenance.  An empty query gives no rows; without query_vector there is no semantic leg.  Ties
    in score go to the smaller id.
    """
    n = min(max(1, args.max_results), MAX_RESULTS)
    require_products(documents, merge_filters(args.product, args.products))
    rows = filtered(sections(chunks, documents), args)
    ranked, strict = legs(rows, args)
    hits = rows.join(F.broadcast(fuse(ranked)), "id")  # at most four pools
    marked = with_tokens(hits, args.analyzer, "__t_")

    def inside(name: str) -> Column:
        ok = F.lit(bool(strict))
        for g in strict:
            any_ = F.lit(False)
            for lexeme in g:
                any_ = any_ | (term_count("__t_", name, lexeme) > 0)
            ok = ok & any_
        return ok

    title, heading = inside("title"), inside("heading")
    none = F.array().cast("array<string>")
    scored = marked.withColumn("score", F.col("score") + F.when(title, TITLE_BONUS).otherwise(0.0) + F.when(heading, HEADING_BONUS).otherwise(0.0))
    scored = scored.withColumn(
        "match_types", F.array_sort(F.concat("legs", F.when(title, F.array(F.lit("title"))).otherwise(none), F.when(heading, F.array(F.lit("heading"))).otherwise(none)))
    )
    best = diversify(collapse(scored, args.latest_only)).orderBy(F.round("score", 9).desc(), "id").limit(n)
    best = best.withColumn("rank", F.row_number().over(W.orderBy(F.round("score", 9).desc(), "id")))
    out = best.select(
        "rank", "id", "section_id", "heading", "title", "url", citation_url(F.col("url"), F.col("anchor")).alias("citation_url"), "product", "version", "canonical_id",
        "breadcrumb", "score", "match_types", "content",
    )
    if not snippets:
        return out.drop("content")
    flat = [x for g in strict for x in g]
    ids = [x for g in analysed(" ".join(identifier_tokens(args.query)) or args.query, "simple") for x in g]
    english = F.arrays_overlap("match_types", F.array(*[F.lit(x) for x in ("keyword", "partial", "title", "heading")]))
    snippet = F.when(english, headline(F.col("content"), flat, args.analyzer)).when(
        F.array_contains("match_types", "identifier"), headline(F.col("content"), ids, "simple")
    ).otherwise(F.substring("content", 1, 500))
    return out.withColumn("snippet", snippet).drop("content")


def hashed_embedding(text: str, dims: int = 64) -> list[float]:
    """Deterministic stand-in for an embedding model: signed feature hashing of stems, unit length."""
    import zlib

    v = [0.0] * dims
    for w in re.findall(r"[a-z0-9]+", text.lower()):
        h = zlib.crc32(stem(w).encode())
        v[h % dims] += 1.0 if h & 0x10000 else -1.0
    norm = sum(x * x for x in v) ** 0.5
    return [x / norm for x in v] if norm else v


def render(results: DataFrame) -> DataFrame:
    """One text per result, numbered, ready to print."""
    head = F.format_string("%d. %s", "rank", F.coalesce("title", F.lit("")))
    line = F.concat_ws("\n", head, F.coalesce("heading", F.lit("")), F.col("citation_url"), F.coalesce("snippet", F.lit("")))
    return results.select("rank", line.alias("text"))
