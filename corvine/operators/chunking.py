"""Heading chunks of Markdown bodies and their stable section ids."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvine.functions.docs import anchor_slug, document_key

SPACE = " \t\n\r\f\v"
# a fence line, a section heading with its level and text, or a first-level heading
MARK = re.compile(r"^(?:(?P<fence>[ \t]*```)|(?P<level>#{2,3})[^\S\n]+(?P<text>[^\n]+)|(?P<top>#)[^\S\n])[^\n]*", re.M)


def split_chunks(body: str) -> list[tuple[str, int, str]]:
    """(heading, level, content) at second and third level headings outside fences; empty sections disappear.

    All marked lines are found in one scan; the parity of the fences before a mark says whether it
    counts, and sections are slices between the headings that do.  First-level headings of the part
    without heading are left out of its slice.
    """
    marks = list(MARK.finditer(body))
    ticks = np.array([m["fence"] is not None for m in marks], int)
    outside = (np.cumsum(ticks) % 2 == 0) & (ticks == 0)
    heads = [m for m, ok in zip(marks, outside) if ok and m["level"]]
    first = heads[0].start() if heads else len(body)
    tops = [(m.start(), min(m.end() + 1, first)) for m, ok in zip(marks, outside) if ok and m["top"] and m.start() < first]
    edges = [0, *(x for span in tops for x in span), first]
    parts = [("", 0, "".join(body[a:b] for a, b in zip(edges[::2], edges[1::2])))]
    ends = [m.start() for m in heads[1:]] + [len(body)]
    parts += [(m["text"], len(m["level"]), body[m.end() : end]) for m, end in zip(heads, ends)]
    return [(heading.strip(SPACE), level, content.strip(SPACE)) for heading, level, content in parts if content.strip(SPACE)]


def chunk_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk_index, heading, heading_level, content of every chunk; null texts have none.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, n, *c) for k, body in zip(*(c.to_pylist() for c in batch.columns)) if body for n, c in enumerate(split_chunks(body))]
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int16(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[key, "chunk_index", "heading", "heading_level", "content"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` bigint, chunk_index int, heading string, heading_level smallint, content string")


def with_section_ids(chunks: DataFrame, key: str, url: str = "url") -> DataFrame:
    """anchor and section_id: repeated anchors of a document are numbered in chunk order."""
    a = chunks.withColumn("anchor", anchor_slug(F.col("heading")))
    n = F.row_number().over(W.partitionBy(key, "anchor").orderBy("chunk_index"))
    suffix = F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(F.lit(""))
    return a.withColumn("section_id", F.concat(document_key(F.col(url)), F.lit("#"), F.col("anchor"), suffix))


def numbered_headings(chunks: DataFrame, key: str, tie: str = "id") -> DataFrame:
    """section_key: the lower-case heading, with #2, #3 for repeats in chunk order, ties by the column ``tie``."""
    low = F.lower(F.coalesce("heading", F.lit("")))
    n = F.row_number().over(W.partitionBy(key, low).orderBy("chunk_index", tie))
    return chunks.withColumn("section_key", F.concat(low, F.when(n > 1, F.concat(F.lit("#"), n.cast("string"))).otherwise(F.lit(""))))
