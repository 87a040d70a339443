"""Half-precision and binary forms: rounding in expressions, arithmetic, text, casts, and the wire forms of half and sparse vectors."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.functions import sparse
from corvine.functions.vectors import format_vector, l2_normalize, parse_vector, same_dims, to_vector
from corvine.operators.aggregates import vector_avg, vector_sum

MAX_HALF = 65504.0


def round_half(x: Column) -> Column:
    """x rounded to 11 significant bits, ties to even; below 2^-14 to steps of 2^-24; beyond MAX_HALF an error."""
    d = x.cast("double")
    size = F.abs(d)
    e = F.floor(F.log2(F.greatest(size, F.lit(2.0**-30))))
    # the logarithm may be off by one next to a power of two
    e = e + F.when(size >= F.pow(F.lit(2.0), e + 1), 1).otherwise(0) - F.when(size < F.pow(F.lit(2.0), e), 1).otherwise(0)
    step = F.pow(F.lit(2.0), F.greatest(e, F.lit(-14)) - 10)
    out = F.rint(d / step) * step
    return F.when(F.abs(out) > MAX_HALF, F.raise_error(F.lit("value out of range for type halfvec"))).otherwise(out).cast("float")


def half(values: Column, dims: int | None = None) -> Column:
    """array<float> of half-precision numbers from an array of numbers, with the type's checks."""
    return F.transform(to_vector(values, dims), round_half)


def parse_half(text: Column, dims: int | None = None) -> Column:
    return F.transform(parse_vector(text, dims), round_half)


def format_half(v: Column) -> Column:
    return format_vector(v)


def _with(f):
    def run(a: Column, b: Column) -> Column:
        return same_dims(a, b, F.transform(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), round_half))

    return run


half_add = _with(lambda x, y: x + y)
half_sub = _with(lambda x, y: x - y)
half_mul = _with(lambda x, y: x * y)


def half_normalize(v: Column) -> Column:
    return F.transform(l2_normalize(v), round_half)


def half_avg(df: DataFrame, vector: str, keys: list[str] | None = None, out: str = "avg") -> DataFrame:
    """Mean vector of each group, summed in double precision and rounded once."""
    return vector_avg(df, vector, keys, out).withColumn(out, F.transform(out, round_half))


def half_sum(df: DataFrame, vector: str, keys: list[str] | None = None, out: str = "sum") -> DataFrame:
    """Sum vector of each group, with partial sums in double precision and rounded once; beyond MAX_HALF an error."""
    return vector_sum(df, vector, keys, out).withColumn(out, F.transform(out, round_half))


@F.pandas_udf(T.BinaryType())
def send_half(values: pd.Series) -> pd.Series:
    """Binary form: dimensions and a zero as int16, then half elements, all big-endian."""
    return values.map(lambda v: None if v is None else struct.pack(">hh", len(v), 0) + np.asarray(v, ">f2").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def receive_half(data: pd.Series) -> pd.Series:
    def one(b):
        if b is None:
            return None
        n, unused = struct.unpack_from(">hh", b)
        if unused or n < 1 or len(b) != 4 + 2 * n:
            raise ValueError("invalid binary halfvec")
        v = np.frombuffer(b, ">f2", n, 4).astype(np.float32)
        if not np.isfinite(v).all():
            raise ValueError("NaN or infinite value not allowed in halfvec")
        return v

    return data.map(one)


@F.pandas_udf(T.BinaryType())
def send_sparse(values: pd.DataFrame) -> pd.Series:
    """Binary form: dimensions, held elements and a zero as int32, then indices from 0 as int32 and float32 values, big-endian."""
    rows = zip(values["dim"], values["indices"], values["values"])
    return pd.Series([None if i is None else struct.pack(">iii", int(d), len(i), 0) + np.asarray(i, ">i4").tobytes() + np.asarray(v, ">f4").tobytes() for d, i, v in rows])


SPARSE = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType()))])


@F.pandas_udf(SPARSE)
def receive_sparse(data: pd.Series) -> pd.DataFrame:
    out = []
    for b in data:
        if b is None:
            out.append((None, None, None))
            continue
        dim, n, unused = struct.unpack_from(">iii", b)
        if unused or n < 0 or dim < 1 or len(b) != 12 + 8 * n:
            raise ValueError("invalid binary sparsevec")
        index, value = np.frombuffer(b, ">i4", n, 12).astype(np.int32), np.frombuffer(b, ">f4", n, 12 + 4 * n).astype(np.float32)
        if (index < 0).any() or (index >= dim).any() or (np.diff(index) <= 0).any():
            raise ValueError("sparsevec indices must be in order and within its dimensions")
        if not np.isfinite(value).all() or not value.all():
            raise ValueError("NaN, infinite or zero value not allowed in sparsevec")
        out.append((dim, index, value))
    return pd.DataFrame(out, columns=["dim", "indices", "values"])


def sparse_l2_squared_distance(a: Column, b: Column) -> Column:
    d = sparse.sparse_l2_distance(a, b)
    return d * d


def sparse_negative_inner_product(a: Column, b: Column) -> Column:
    return -sparse.sparse_inner_product(a, b)


def sparse_of_dims(s: Column, dims: int) -> Column:
    """s if it has that many dimensions, else an error."""
    text = F.concat(F.lit(f"expected {dims} dimensions, not "), s["dim"].cast("string"))
    return F.when(s["dim"] == dims, s).when(s["dim"] != dims, F.raise_error(text))


def sparse_compare(a: Column, b: Column) -> dict[str, Column]:
    """The six comparisons of sparse vectors, which order as their dense forms do."""
    c = sparse.sparse_cmp(a, b)
    return {"lt": c < 0, "le": c <= 0, "eq": c == 0, "ne": c != 0, "ge": c >= 0, "gt": c > 0}
