"""Splitting oversized sections at natural boundaries with overlap (problem 3).

Every section has a list of boundaries: block starts, and inside blocks that exceed the limit line
starts, word starts and, in a run without blanks, fixed steps.  Each boundary is joined to its
farthest legal successor, the one that keeps the piece with its overlap under the limit.  Squaring
the successor table (pointer doubling) marks all boundaries on the greedy path from the start in
log2(boundaries) rounds, for all sections of an Arrow batch at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvine.llm.blocks import block_starts, lines_of

BLANK = re.compile(r"\s+")
BATCH_CHARS = 4_000_000
"""Characters of text whose successor tables are squared together."""


def boundaries(text: str, limit: int, overlap: int) -> list[int]:
    """Sorted offsets at which text may be cut, from 0 to its length, no two further apart than limit - overlap."""
    step = limit - overlap
    marks = sorted({0, *block_starts(text), len(text)})
    finer = [at for at, _ in lines_of(text)]
    for find in (lambda: finer, lambda: [m.end() for m in BLANK.finditer(text)]):
        if all(b - a <= step for a, b in zip(marks, marks[1:])):
            return marks
        more = np.array(find())
        add: list[int] = []
        for a, b in zip(marks, marks[1:]):
            if b - a > step:
                add += more[(more > a) & (more < b)].tolist()
        marks = sorted({*marks, *add})
    out = [marks[0]]
    for b in marks[1:]:
        while b - out[-1] > step:
            out.append(out[-1] + step)
        out.append(b)
    return out


def successors(at: np.ndarray, section: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """Index of each boundary's farthest legal successor; the last boundary of a section is its own."""
    n, first = len(at), np.r_[True, section[1:] != section[:-1]]
    # offsets of all sections on one axis, far enough apart that no search leaves its section
    base = section * (int(at.max(initial=0)) + 2 * limit + 2)
    line = base + at
    reach = line + np.where(first, limit, limit - overlap)
    nxt = np.searchsorted(line, reach, side="right") - 1
    last = np.r_[first[1:], True]
    end = np.flatnonzero(last)[np.cumsum(np.r_[0, last[:-1]])]
    return np.where(last, np.arange(n), np.minimum(nxt, end))


def greedy_cuts(at: np.ndarray, section: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """Mask of the boundaries on each section's greedy path, by squaring the successor table."""
    nxt = successors(at, section, limit, overlap)
    on = np.r_[True, section[1:] != section[:-1]]
    for _ in range(max(1, int(np.ceil(np.log2(max(2, len(at)))))) + 1):
        reached = on.copy()
        reached[nxt[on]] = True
        if (nxt == nxt[nxt]).all() and (reached == on).all():
            break
        on, nxt = reached, nxt[nxt]
    return on


def pieces_of(texts: list[str], limit: int, overlap: int) -> list[list[tuple[int, int]]]:
    """(start, end) of the pieces of each text: at most limit long, neighbours sharing overlap characters."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    bounds = [boundaries(t, limit, overlap) for t in texts]
    if not bounds:
        return []
    at = np.concatenate([np.asarray(b, np.int64) for b in bounds])
    section = np.repeat(np.arange(len(bounds)), [len(b) for b in bounds])
    on = greedy_cuts(at, section, limit, overlap)
    out = []
    for k, cuts in enumerate(np.split(at[on], np.cumsum(np.bincount(section[on], minlength=len(bounds)))[:-1])):
        c = cuts.tolist()
        if len(c) == 1:
            out.append([(0, len(texts[k]))] if texts[k] else [])
        else:
            out.append([(max(0, a - overlap) if i else 0, b) for i, (a, b) in enumerate(zip(c, c[1:]))])
    return out


def _grouped(rows: list[tuple]) -> Iterator[list[tuple]]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[1])
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def split_sections(df: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """id, piece_no, start_pos, end_pos, heading, heading_level, piece, block_starts of every section.

    Sections of at most ``limit`` code points come out as one piece; null contents have no piece, empty
    ones neither.  block_starts holds the offsets of the section's blocks that lie in the part the piece
    adds.  Repeated rows stay repeated; other columns are not read.  No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for group in _grouped([r for r in rows if r[1]]):
                out: list[tuple] = []
                long = [r[1] for r in group if len(r[1]) > limit]
                cut = iter(pieces_of(long, limit, overlap))
                for id_, text, heading, level in group:
                    blocks = block_starts(text)
                    if len(text) <= limit:
                        out.append((id_, 0, 0, len(text), heading, level, text, blocks))
                        continue
                    done = 0
                    for n, (a, b) in enumerate(next(cut)):
                        out.append((id_, n, a, b, heading, level, text[a:b], [x for x in blocks if done <= x < b]))
                        done = b
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names=[n for n, _ in FIELDS]
                )

    schema = ", ".join(f"{n} {t}" for n, t in FIELDS)
    return df.select("id", "content", "heading", "heading_level").mapInArrow(run, schema)


FIELDS = [
    ("id", "bigint"), ("piece_no", "int"), ("start_pos", "int"), ("end_pos", "int"), ("heading", "string"),
    ("heading_level", "smallint"), ("piece", "string"), ("block_starts", "array<int>"),
]
TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int16(), pa.string(), pa.list_(pa.int32())]
