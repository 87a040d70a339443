"""Streaming ingest: Markdown directory to documents and chunks, and streaming inserts into an inverted-list index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators import ivf
from corvine.operators.chunking import chunk_documents, with_section_ids


def markdown_stream(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """value and path of the Markdown files that arrive below folder."""
    return (
        spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]")
        .option("maxFilesPerTrigger", per_batch).load(folder).select("value", F.col("_metadata.file_path").alias("path"))
    )


def ingest_batch(files: DataFrame) -> DataFrame:
    """Section rows of one batch of files(value, path): url, chunk_index, heading, content, section_id."""
    body = F.regexp_replace("value", r"(?s)^---\r?\n.*?\r?\n---[ \t]*\r?\n", "")
    url = F.trim(F.regexp_extract("value", r"(?m)^url:[ \t]*(\S+)", 1))
    docs = files.select(F.xxhash64("path").alias("doc_id"), F.when(url != "", url).otherwise(F.col("path")).alias("url"), body.alias("text"))
    return with_section_ids(chunk_documents(docs).join(docs.select("doc_id", "url"), "doc_id"), "doc_id")


def start_ingest(files: DataFrame, target: str, checkpoint: str):
    """A query that appends each batch's sections to target, partitioned by batch so that a replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        ingest_batch(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_sections(spark: SparkSession, target: str) -> DataFrame:
    """Sections as of the last batch of each url: a file that changed replaces what it held before."""
    rows = spark.read.parquet(target)
    last = rows.groupBy("url").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["url", "batch"], "left_semi").drop("batch")


def start_index_inserts(rows: DataFrame, index: ivf.IvfIndex, path: str, checkpoint: str):
    """A query that assigns arriving vectors to their lists below path, by batch, so that a replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        ivf.insert(index, batch, f"{path}/batch={number}", mode="overwrite")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
