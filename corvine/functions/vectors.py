"""Dense vectors as array<float> columns: distances, arithmetic, comparison, casts and text form.

Every function is null for null arguments and raises on vectors of different length; distances are
accumulated in double.  Limits follow the vector type: 1 to 16000 finite elements.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DIMS = 16_000
MAX_FLOAT32 = 3.4028234663852886e38


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _checked(ok: Column, value: Column, message) -> Column:
    """value where ok, an error where not, null where ok is unknown."""
    return F.when(ok, value).when(~ok, F.raise_error(F.lit(message) if isinstance(message, str) else message))


def same_dims(a, b, value: Column) -> Column:
    a, b = _col(a), _col(b)
    text = F.concat(F.lit("different vector dimensions "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    return _checked(F.size(a) == F.size(b), value, text)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _pairs(a, b, f) -> Column:
    return F.zip_with(_col(a).cast("array<double>"), _col(b).cast("array<double>"), f)


def l2_squared_distance(a, b) -> Column:
    return same_dims(a, b, _sum(_pairs(a, b, lambda x, y: (x - y) * (x - y))))


def l2_distance(a, b) -> Column:
    return F.sqrt(l2_squared_distance(a, b))


def inner_product(a, b) -> Column:
    return same_dims(a, b, _sum(_pairs(a, b, lambda x, y: x * y)))


def negative_inner_product(a, b) -> Column:
    return -inner_product(a, b)


def l1_distance(a, b) -> Column:
    return same_dims(a, b, _sum(_pairs(a, b, lambda x, y: F.abs(x - y))))


def _squares(a) -> Column:
    return _sum(F.transform(_col(a).cast("array<double>"), lambda x: x * x))


def cosine_distance(a, b) -> Column:
    """1 - cosine similarity, clamped to 0..2; NaN when a vector is all zeros."""
    norm = F.sqrt(_squares(a) * _squares(b))
    similarity = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(inner_product(a, b), norm)))
    return F.when(norm == 0, F.lit(float("nan"))).otherwise(1 - similarity)


def spherical_distance(a, b) -> Column:
    """Angle between unit vectors as a share of pi."""
    dot = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner_product(a, b)))
    return F.acos(dot) / F.pi()


def vector_dims(a) -> Column:
    return F.when(_col(a).isNotNull(), F.size(_col(a)))


def vector_norm(a) -> Column:
    return F.sqrt(_squares(a))


def l2_normalize(a) -> Column:
    """Unit vector of the same direction; a zero vector stays zero."""
    norm = vector_norm(a)
    return F.when(norm == 0, _col(a).cast("array<float>")).otherwise(
        F.transform(_col(a), lambda x: (x.cast("double") / norm).cast("float"))
    )


def _finite(values: Column, message: str) -> Column:
    bad = F.exists(values, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return _checked(~bad, values, message)


def _elementwise(a, b, f) -> Column:
    out = F.zip_with(_col(a).cast("array<double>"), _col(b).cast("array<double>"), lambda x, y: f(x, y).cast("float"))
    return same_dims(a, b, _finite(out, "value out of range: overflow"))


def vector_add(a, b) -> Column:
    return _elementwise(a, b, lambda x, y: x + y)


def vector_sub(a, b) -> Column:
    return _elementwise(a, b, lambda x, y: x - y)


def vector_mul(a, b) -> Column:
    """Element-wise product; overflow and underflow to zero are errors."""
    out = _elementwise(a, b, lambda x, y: x * y)
    under = F.exists(
        F.zip_with(out, F.zip_with(_col(a), _col(b), lambda x, y: (x != 0) & (y != 0)), lambda z, nz: (z == 0) & nz), lambda v: v
    )
    return _checked(~under, out, "value out of range: underflow")


def vector_concat(a, b) -> Column:
    out = F.concat(_col(a), _col(b))
    return _checked(F.size(out) <= MAX_DIMS, out, f"vector cannot have more than {MAX_DIMS} dimensions")


def binary_quantize(a) -> Column:
    """A '0'/'1' string, 1 where the element is above zero, first element first."""
    return F.array_join(F.transform(_col(a), lambda x: F.when(x > 0, "1").otherwise("0")), "")


def subvector(a, start: Column | int, count: Column | int) -> Column:
    """count elements from the 1-based start; what lies outside is cut off, an empty result is an error."""
    a = _col(a)
    first = F.lit(start).cast("bigint") if isinstance(start, int) else start.cast("bigint")
    n = F.lit(count).cast("bigint") if isinstance(count, int) else count.cast("bigint")
    end = F.least(first + n, F.size(a).cast("bigint") + 1)
    begin = F.greatest(first, F.lit(1).cast("bigint"))
    ok = (n >= 1) & (begin < end)
    return _checked(ok, F.slice(a, F.when(ok, begin).otherwise(1).cast("int"), F.when(ok, end - begin).otherwise(1).cast("int")), "vector must have at least 1 dimension")


def vector_cmp(a, b) -> Column:
    """-1, 0 or 1: element values first, then length."""
    a, b = _col(a), _col(b)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def to_vector(values, dims: int | None = None) -> Column:
    """array<float> from an array of numbers, with the type's checks."""
    v = _col(values)
    out = F.transform(v, lambda x: x.cast("double").cast("float"))
    ok = F.forall(v, lambda x: x.isNotNull())
    out = _checked(ok, out, "array must not contain nulls")
    out = _checked((F.size(v) >= 1) & (F.size(v) <= MAX_DIMS), out, f"vector must have 1 to {MAX_DIMS} dimensions")
    if dims is not None:
        if not 1 <= dims <= MAX_DIMS:
            raise ValueError(f"dimensions must be 1 to {MAX_DIMS}")
        out = _checked(F.size(v) == dims, out, F.concat(F.lit(f"expected {dims} dimensions, not "), F.size(v).cast("string")))
    return _finite(out, "value out of range for type vector")


NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
VECTOR_TEXT = rf"^\s*\[\s*{NUMBER}\s*(?:,\s*{NUMBER}\s*)*\]\s*$"


def parse_vector(text, dims: int | None = None) -> Column:
    """array<float> from '[1,2,3]'; anything else is an error."""
    t = _col(text)
    inner = F.regexp_replace(t, r"[\[\]\s]", "")
    ok = t.rlike(VECTOR_TEXT)
    values = F.transform(F.split(F.when(ok, inner), ","), lambda x: x.cast("double"))
    return _checked(ok, to_vector(values, dims), F.concat(F.lit("invalid input syntax for type vector: "), t))


def number_text(x: Column) -> Column:
    """Shortest text of a float; integral values without a fraction."""
    plain = F.regexp_replace(x.cast("string"), r"\.0$", "")
    return F.regexp_replace(F.regexp_replace(plain, r"\.0E", "e"), "E", "e")


def format_vector(a) -> Column:
    return F.when(_col(a).isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(_col(a), number_text), ","), F.lit("]")))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def to_half(values: pd.Series) -> pd.Series:
    """Elements rounded to half precision; out of range is an error, tiny values become 0."""
    import numpy as np

    def one(v):
        if v is None:
            return None
        with np.errstate(over="ignore"):
            h = np.asarray(v, np.float32).astype(np.float16)
        if not np.isfinite(h).all():
            raise ValueError("value out of range for type halfvec")
        return h.astype(np.float32)

    return values.map(one)


@F.pandas_udf(T.BinaryType())
def send_vector(values: pd.Series) -> pd.Series:
    """Binary form: dimensions and a zero as int16, then float32 elements, all big-endian."""
    import struct

    import numpy as np

    return values.map(lambda v: None if v is None else struct.pack(">hh", len(v), 0) + np.asarray(v, ">f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def receive_vector(data: pd.Series) -> pd.Series:
    import struct

    import numpy as np

    def one(b):
        if b is None:
            return None
        n, unused = struct.unpack_from(">hh", b)
        if unused != 0 or len(b) != 4 + 4 * n or n < 1:
            raise ValueError("invalid binary vector")
        v = np.frombuffer(b, ">f4", n, 4).astype(np.float32)
        if not np.isfinite(v).all():
            raise ValueError("NaN or infinite value not allowed in vector")
        return v

    return data.map(one)


METRICS = {
    "l2": l2_distance,
    "ip": negative_inner_product,
    "cosine": cosine_distance,
    "l1": l1_distance,
}


def indexable(a, metric: str) -> Column:
    """Rows an index holds: no null vectors, and no zero vectors under cosine."""
    ok = _col(a).isNotNull()
    return ok & (vector_norm(a) > 0) if metric == "cosine" else ok


SQL_FUNCTIONS = {
    "l2_distance": "sqrt(aggregate(zip_with(a, b, (x, y) -> (double(x) - y) * (double(x) - y)), 0D, (s, x) -> s + x))",
    "inner_product": "aggregate(zip_with(a, b, (x, y) -> double(x) * y), 0D, (s, x) -> s + x)",
    "l1_distance": "aggregate(zip_with(a, b, (x, y) -> abs(double(x) - y)), 0D, (s, x) -> s + x)",
}


def register(spark: SparkSession) -> None:
    """Temporary SQL functions of the same names, so that SQL text can call them."""
    guard = "if(size(a) = size(b), {}, raise_error('different vector dimensions'))"
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN {guard.format(body)}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_dims(a ARRAY<FLOAT>) RETURNS INT RETURN size(a)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_norm(a ARRAY<FLOAT>) RETURNS DOUBLE RETURN sqrt(aggregate(a, 0D, (s, x) -> s + double(x) * x))")
