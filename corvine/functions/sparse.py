"""Sparse vectors as struct<dim int, indices array<int>, values array<float>>; indices from 0, ascending, no zeros."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvine.functions.vectors import NUMBER, number_text

MAX_DIM, MAX_NNZ = 1_000_000_000, 16_000
SPARSE_TEXT = rf"^\s*\{{\s*(?:\d+\s*:\s*{NUMBER}\s*(?:,\s*\d+\s*:\s*{NUMBER}\s*)*)?\}}\s*/\s*\d+\s*$"


def _error(message) -> Column:
    return F.raise_error(F.lit(message) if isinstance(message, str) else message)


def _of(dim: Column, entries: Column) -> Column:
    """From an array of struct<i, v>: sorted, without zeros."""
    kept = F.array_sort(F.filter(entries, lambda e: e["v"] != 0))
    return F.struct(dim.cast("int").alias("dim"), F.transform(kept, lambda e: e["i"]).alias("indices"), F.transform(kept, lambda e: e["v"]).alias("values"))


def _value(s: Column, i: Column) -> Column:
    """Element of index i, 0 where none is held; a scan of the indices, since a map would be built anew for each i."""
    return F.coalesce(F.get(s["values"], F.array_position(s["indices"], i).cast("int") - 1), F.lit(0.0).cast("float"))


def from_dense(a: Column) -> Column:
    """Zeros are dropped after rounding to float."""
    entries = F.transform(a, lambda x, k: F.struct(k.alias("i"), x.cast("float").alias("v")))
    return F.when(a.isNotNull(), _of(F.size(a), entries))


def to_dense(s: Column) -> Column:
    """array<float>; at most 16000 dimensions."""
    out = F.transform(F.sequence(F.lit(0), s["dim"] - 1), lambda k: _value(s, k))
    return F.when(s["dim"] <= 16_000, out).when(s["dim"] > 16_000, _error("vector cannot have more than 16000 dimensions"))


def parse_sparse(text: Column) -> Column:
    """From '{1:1.5,3:2}/5', indices from 1; any order; duplicates, indices out of range and underflow are errors."""
    ok = text.rlike(SPARSE_TEXT)
    t = F.when(ok, F.regexp_replace(text, r"\s", ""))
    dim = F.regexp_extract(t, r"/(\d+)$", 1).try_cast("bigint")
    body = F.regexp_extract(t, r"\{(.*)\}", 1)
    items = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, ","))
    entries = F.transform(
        items, lambda e: F.struct((F.split_part(e, F.lit(":"), F.lit(1)).cast("bigint") - 1).cast("int").alias("i"), F.split_part(e, F.lit(":"), F.lit(2)).cast("double").cast("float").alias("v"))
    )
    index = F.transform(entries, lambda e: e["i"])
    lost = F.exists(items, lambda e: (F.split_part(e, F.lit(":"), F.lit(2)).cast("double") != 0) & (F.split_part(e, F.lit(":"), F.lit(2)).cast("double").cast("float") == 0))
    return (
        F.when(text.isNull(), None)
        .when(~ok, _error(F.concat(F.lit("invalid input syntax for type sparsevec: "), text)))
        .when((dim < 1) | (dim > MAX_DIM), _error("sparsevec dimensions out of range"))
        .when(F.size(F.array_distinct(index)) < F.size(index), _error("sparsevec indices must not contain duplicates"))
        .when(F.exists(index, lambda i: (i < 0) | (i >= dim)), _error("sparsevec index out of bounds"))
        .when(lost, _error("value out of range for type sparsevec"))
        .otherwise(_of(dim, entries))
    )


def format_sparse(s: Column) -> Column:
    items = F.zip_with(s["indices"], s["values"], lambda i, v: F.concat((i + 1).cast("string"), F.lit(":"), number_text(v)))
    return F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}/"), s["dim"].cast("string"))


def _merged(a: Column, b: Column, f) -> Column:
    """f over every index either vector holds, missing values 0."""
    value = lambda s, i: _value(s, i).cast("double")
    total = F.aggregate(F.transform(F.array_union(a["indices"], b["indices"]), lambda i: f(value(a, i), value(b, i))), F.lit(0.0), lambda s, x: s + x)
    ok = a["dim"] == b["dim"]
    return F.when(ok, total).when(~ok, _error("different sparsevec dimensions"))


def sparse_l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_merged(a, b, lambda x, y: (x - y) * (x - y)))


def sparse_l1_distance(a: Column, b: Column) -> Column:
    return _merged(a, b, lambda x, y: F.abs(x - y))


def sparse_inner_product(a: Column, b: Column) -> Column:
    return _merged(a, b, lambda x, y: x * y)


def sparse_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a["values"], F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def sparse_cosine_distance(a: Column, b: Column) -> Column:
    norm = sparse_norm(a) * sparse_norm(b)
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(sparse_inner_product(a, b), norm)))
    return F.when(norm == 0, F.lit(float("nan"))).otherwise(1 - s)


def sparse_normalize(a: Column) -> Column:
    """Unit length; entries that become 0 are dropped, a zero vector stays."""
    n = sparse_norm(a)
    entries = F.zip_with(a["indices"], a["values"], lambda i, v: F.struct(i.alias("i"), (v.cast("double") / n).cast("float").alias("v")))
    return F.when(n == 0, a).otherwise(_of(a["dim"], entries))


def sparse_cmp(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as the dense vectors compare: by the first index where they differ, then by dimension."""
    shared = F.filter(F.array_sort(F.array_union(a["indices"], b["indices"])), lambda i: (i < a["dim"]) & (i < b["dim"]))
    first = F.get(F.filter(shared, lambda i: _value(a, i) != _value(b, i)), 0)
    by_value = F.when(_value(a, first) < _value(b, first), -1).otherwise(1)
    by_dim = F.when(a["dim"] < b["dim"], -1).when(a["dim"] > b["dim"], 1).otherwise(0)
    return F.when(a.isNull() | b.isNull(), None).when(first.isNotNull(), by_value).otherwise(by_dim)
