"""Queries of the training-data problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.mainbody import main_content
from corvine.llm.markup import strip_markup, strip_pages
from corvine.llm.mixing import mixture
from corvine.llm.neighbours import similar_pairs
from corvine.llm.pii import find_pieces, redact
from corvine.llm.repetition import repeated_lines, without_repeated_lines
from corvine.llm.splitting import split_sections
from corvine.llm.tokens import count_tokens, encode_corpus
from corvine.session import materialize, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similar_pairs(table(spark, sf_dir, "chunks"), k=10, least=0.90)
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = materialize(main_content(table(spark, sf_dir, "page_content"), texts=False), "bodies")
    field = lambda name, places: F.explode(F.transform(places, lambda p: F.struct(F.lit(name).alias("field_name"), p.alias("pos"))))
    body = pages.select("page_id", field("content_html", "body_nodes").alias("x"))
    trail = pages.select("page_id", field("breadcrumbs", "trail_places").alias("x"))
    return body.unionByName(trail).select("page_id", "x.*")


def p2_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_content(table(spark, sf_dir, "page_content")).select("page_id", "body_text", F.array_join("trail", " > ").alias("trail"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_sections(table(spark, sf_dir, "chunks").filter(F.length("content") > 2000))
    return pieces.select("id", F.explode("block_starts").alias("start_pos"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sections(table(spark, sf_dir, "chunks")).drop("block_starts")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "documents")).select("id", "line_no")


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_markup(table(spark, sf_dir, "chunks"), clean=False).select("id", F.explode("kinds").alias("kind"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_markup(table(spark, sf_dir, "chunks")).select("id", "clean")


def p6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_pages(table(spark, sf_dir, "page_content"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counted = count_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "manual"])
    return mixture(materialize(counted, "tokens"), table(spark, sf_dir, "mix_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pieces(table(spark, sf_dir, "documents")).select("doc_id", "kind", "start_pos")


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_body": p2_body,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_clean": p4_clean,
    "p6_found": p6_found,
    "p6_clean": p6_clean,
    "p6_pages": p6_pages,
    "p8_ids": p8_ids,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_redacted": p10_redacted,
}

ORACLE: dict[str, str] = {}
