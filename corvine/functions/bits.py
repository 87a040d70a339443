"""Bit strings as '0'/'1' text: packing to 64-bit words, Hamming and Jaccard distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(bits: Column) -> Column:
    """64-bit words of a bit string, the last one filled up with zeros."""
    n = F.ceil(F.length(bits) / 64).cast("int")
    part = lambda k: F.rpad(F.substring(bits, k * 64 + 1, 64), 64, "0")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # halves, since a full word does not fit conv's signed result
    half = lambda s: F.conv(s, 2, 10).cast("bigint")
    return F.transform(index, lambda k: F.shiftleft(half(F.substring(part(k), 1, 32)), 32).bitwiseOR(half(F.substring(part(k), 33, 32))))


def _same_length(a: Column, b: Column, value: Column) -> Column:
    ok = F.length(a) == F.length(b)
    return F.when(ok, value).when(~ok, F.raise_error(F.lit("different bit lengths")))


def _count(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(f(x, y))), F.lit(0), lambda s, x: s + x)


def hamming_distance(a: Column, b: Column) -> Column:
    """Number of places that differ; 0 for two empty strings."""
    return _same_length(a, b, _count(words(a), words(b), lambda x, y: x.bitwiseXOR(y)).cast("double"))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - shared ones / all ones; 1 when no one is shared."""
    both = _count(words(a), words(b), lambda x, y: x.bitwiseAND(y))
    any_ = _count(words(a), words(b), lambda x, y: x.bitwiseOR(y))
    return _same_length(a, b, F.when(both == 0, 1.0).otherwise(1 - F.try_divide(both.cast("double"), any_.cast("double"))))
