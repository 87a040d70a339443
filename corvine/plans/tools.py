"""Page-level plans: section with neighbours, page reassembly, catalogue, alias resolution, version comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.functions.docs import document_aliases, parse_version, rfc3339
from corvine.operators.chunking import numbered_headings

MAX_CONTEXT, MAX_CHARS, DIFF_LINES, DIFF_CONTEXT = 5, 12_000, 400, 2


def section_context(chunks: DataFrame, before: int = 1, after: int = 1, max_chars: int = MAX_CHARS) -> DataFrame:
    """Every section with its neighbours: content, and arrays of struct<chunk_index, heading, content> before and after.

    Context is clamped to 0..5 sections; contents are cut at max_chars characters.  One window by document.
    """
    before, after = (min(max(0, n), MAX_CONTEXT) for n in (before, after))
    cut = F.substring("content", 1, max_chars)
    item = F.struct("chunk_index", F.coalesce("heading", F.lit("")).alias("heading"), cut.alias("content"))
    by = W.partitionBy("document_id").orderBy("chunk_index", "id")
    near = lambda lo, hi: F.collect_list(item).over(by.rowsBetween(lo, hi))
    none = F.array().cast("array<struct<chunk_index:int,heading:string,content:string>>")
    return chunks.select(
        "id", "document_id", "section_id", "chunk_index", "heading", cut.alias("content"),
        (near(-before, -1) if before else none).alias("before"), (near(1, after) if after else none).alias("after"),
    )


def get_section(chunks: DataFrame, documents: DataFrame, section_id: str, before: int = 0, after: int = 0, max_chars: int = MAX_CHARS) -> DataFrame:
    """One section with its page and neighbours; colliding ids give the first by document and place."""
    of = chunks.filter(F.col("section_id") == section_id).orderBy("document_id", "chunk_index").limit(1).select("document_id", F.col("id").alias("__id"))
    own = chunks.join(F.broadcast(of), "document_id")  # one row
    full = section_context(own, before, after, max_chars).join(F.broadcast(of.select(F.col("__id").alias("id"))), "id")
    return full.join(documents.select(F.col("doc_id").alias("document_id"), "url", "title", "product", "version"), "document_id")


def pages(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, url, page: every page put together from its sections in order.

    Header with title and breadcrumb; each section's heading at its level, 2 where the level is not 2 to 6.
    """
    level = F.when(F.col("heading_level").between(2, 6), F.col("heading_level")).otherwise(2)
    head = F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("heading"), F.lit("\n"))).otherwise(F.lit(""))
    body = chunks.select(F.col("document_id").alias("doc_id"), "chunk_index", "id", F.concat(head, F.coalesce("content", F.lit("")), F.lit("\n")).alias("part"))
    parts = body.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "id", "part"))), lambda s: s["part"]), "\n").alias("body"))
    top = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n"), F.when(F.coalesce("breadcrumb", F.lit("")) != "", F.concat(F.col("breadcrumb"), F.lit("\n"))).otherwise(F.lit("")), F.lit("\n"))
    return documents.select("doc_id", "url", "title", "breadcrumb").join(parts, "doc_id").select("doc_id", "url", F.concat(top, "body").alias("page"))


def aliases(documents: DataFrame) -> DataFrame:
    """alias, doc_id of every document, each pair once."""
    return documents.select(F.explode(document_aliases(F.col("url"), F.coalesce("canonical_id", F.lit("")))).alias("alias"), "doc_id").distinct()


def resolve(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """url, resolved_id, by_alias for wanted(url, tries array of aliases).

    A url that is stored resolves to itself.  Else the first alias with any hit decides; of its hits the
    newest version wins, then the shorter url.
    """
    exact = wanted.join(documents.select("url", F.col("doc_id").alias("own")), "url", "left")
    tries = exact.filter("own is null").select("url", F.posexplode("tries").alias("turn", "alias"))
    hits = tries.join(aliases(documents), "alias").join(documents.select("doc_id", F.col("url").alias("target"), "version"), "doc_id")
    by = W.partitionBy("url").orderBy("turn", parse_version(F.col("version")).desc_nulls_last(), F.length("target"), "doc_id")
    best = hits.withColumn("n", F.row_number().over(by)).filter("n = 1").select("url", F.col("doc_id").alias("found"))
    return exact.join(best, "url", "left").select("url", F.coalesce("own", "found").alias("resolved_id"), F.col("own").isNull().alias("by_alias"))


def docset_versions(documents: DataFrame, manuals: bool = False) -> DataFrame:
    """Pages, last updates and (on request) manuals by product and version, newest version first within a product."""
    aggs = [F.count(F.lit(1)).alias("pages"), F.max("source_updated_at").alias("source_updated"), F.max("updated_at").alias("indexed_at")]
    if manuals:
        aggs.append(F.array_sort(F.collect_set(F.when(F.col("manual") != "", F.col("manual")))).alias("manuals"))
    rows = documents.groupBy("product", "version").agg(*aggs)
    out = rows.withColumns({"source_updated": rfc3339(F.col("source_updated")), "indexed_at": rfc3339(F.col("indexed_at"))})
    return out.orderBy("product", parse_version(F.col("version")).desc_nulls_last(), F.col("version").desc_nulls_last())


def docsets(documents: DataFrame, product: str | None = None, manuals: bool = False) -> DataFrame:
    """product, pages, latest, versions: the catalogue with its versions nested, newest first; manuals only for one product."""
    rows = docset_versions(documents if product is None else documents.filter(F.col("product") == product), manuals and product is not None)
    order = F.row_number().over(W.partitionBy("product").orderBy(parse_version(F.col("version")).desc_nulls_last(), F.col("version").desc_nulls_last()))
    cols = [c for c in rows.columns if c != "product"]
    nested = rows.withColumn("n", order).groupBy("product").agg(
        F.sum("pages").alias("pages"), F.min_by("version", "n").alias("latest"), F.transform(F.sort_array(F.collect_list(F.struct("n", *cols))), lambda s: F.struct(*[s[c].alias(c) for c in cols])).alias("versions")
    )
    return nested.orderBy("product")


# Fixed value: stands for the lines of a section beyond DIFF_LINES.
TRUNCATED = "[section truncated for diff]"


def _frontiers(a: list[str], b: list[str]) -> list[dict[int, int]]:
    """Per number of edits d the least place in a, by diagonal, from which the ends are d edits away (greedy, from the ends)."""
    out: list[dict[int, int]] = []
    for d in range(len(a) + len(b) + 1):
        row: dict[int, int] = {}
        for k in range(-d, d + 1, 2):  # diagonal: place in a less place in b, seen from the ends
            if not d:
                x = 0
            else:
                x = max(out[-1].get(k - 1, -2) + 1, out[-1].get(k + 1, -2))
            y = x - k
            if x < 0 or y < 0 or x > len(a) or y > len(b):
                continue
            while x < len(a) and y < len(b) and a[-1 - x] == b[-1 - y]:
                x, y = x + 1, y + 1
            row[k] = x
        out.append(row)
        if row.get(len(a) - len(b)) == len(a):
            return out
    return out


def _edits(a: list[str], b: list[str]) -> Iterator[str]:
    """Signed lines of a shortest edit: common lines as early as they come, removals before additions."""
    fronts = _frontiers(a, b)
    left, i, j = len(fronts) - 1, 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            yield " " + a[i]
            i, j = i + 1, j + 1
            continue
        left -= 1
        rest = len(a) - i - 1
        # after removing a line the end is left edits away if the frontier of its diagonal reaches it
        if i < len(a) and fronts[left].get(rest - (len(b) - j), -1) >= rest:
            yield "-" + a[i]
            i += 1
        else:
            yield "+" + b[j]
            j += 1


def line_diff(old: str, new: str, context: int = DIFF_CONTEXT, limit: int = DIFF_LINES) -> str:
    """Changed lines with - and +, ``context`` lines around them, runs left out as '@@ n unchanged line(s) @@'.

    A text of more than ``limit`` lines is compared by its first ones and TRUNCATED as its last line, so
    a change of size alone shows too; no change gives ''.
    """
    a, b = (lines if len(lines) <= limit else [*lines[:limit], TRUNCATED] for lines in (old.split("\n"), new.split("\n")))
    lines = list(_edits(a, b))
    changed = np.array([s[0] != " " for s in lines])
    if not changed.any():
        return ""
    shown = np.convolve(changed, np.ones(2 * context + 1), mode="full")[context : context + len(lines)] > 0
    out: list[str] = []
    for seen, run in groupby(zip(shown, lines), key=lambda x: x[0]):
        run = [line for _, line in run]
        out += run if seen else [f"@@ {len(run)} unchanged line(s) @@"]
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([line_diff(o or "", n or "") for o, n in zip(old, new)])


def compare_documents(chunks: DataFrame, pairs: DataFrame, diffs: bool = True) -> DataFrame:
    """Changed sections of pairs(pair, old_id, new_id): section_key, status, place and (with diffs) diff.

    Sections match by lower-case heading, repeats numbered in order; unchanged ones are left out.
    Surviving sections stand at their place in the new page, removed ones at 2 * place + 1.
    """
    place = F.row_number().over(W.partitionBy("document_id").orderBy("chunk_index", "id")) - 1
    keyed = numbered_headings(chunks, "document_id").select("document_id", "section_key", F.coalesce("content", F.lit("")).alias("content"), place.alias("place"))
    side = lambda c: pairs.select("pair", F.col(c).alias("document_id")).join(keyed, "document_id").drop("document_id")
    old = side("old_id").withColumnsRenamed({"content": "old", "place": "old_place"})
    new = side("new_id").withColumnsRenamed({"content": "new", "place": "new_place"})
    both = old.join(new, ["pair", "section_key"], "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    out = both.withColumn("status", status).filter("status is not null").withColumn("place", F.coalesce("new_place", 2 * F.col("old_place") + 1))
    if diffs:
        return out.select("pair", "section_key", "status", "place", unified_diff("old", "new").alias("diff"))
    return out.select("pair", "section_key", "status", "place")


def version_pairs(documents: DataFrame) -> DataFrame:
    """pair (canonical id), old_id, new_id: every page's newest version with the one before."""
    rows = documents.filter((F.coalesce("canonical_id", F.lit("")) != "") & parse_version(F.col("version")).isNotNull())
    by = W.partitionBy("canonical_id").orderBy(parse_version(F.col("version")).desc(), "doc_id")
    rows = rows.select(F.col("canonical_id").alias("pair"), F.col("doc_id").alias("new_id"), F.lead("doc_id").over(by).alias("old_id"), F.row_number().over(by).alias("n"))
    return rows.filter("n = 1 and old_id is not null").select("pair", "old_id", "new_id")
