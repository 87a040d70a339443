"""Vector aggregates: average and sum per group, by element position with partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _by_element(df: DataFrame, keys: list[str], vector: str, agg) -> DataFrame:
    """One hash aggregation on (keys, position), combined on the map side, then one array per group.

    Nulls are skipped; a group without vectors gives null; vectors of different length are an error.
    """
    rows = df.select(*keys, F.col(vector).alias("__v"))
    parts = rows.select(*keys, F.size(F.when(F.col("__v").isNotNull(), F.col("__v"))).alias("__n"), F.posexplode("__v").alias("__p", "__x"))
    cells = parts.groupBy(*keys, "__p").agg(agg(F.col("__x").cast("double")).alias("__x"), F.min("__n").alias("__lo"), F.max("__n").alias("__hi"))
    same = F.min("__lo") == F.max("__hi")
    values = F.transform(F.sort_array(F.collect_list(F.struct("__p", "__x"))), lambda s: s["__x"])
    value = F.when(same, values).otherwise(F.raise_error(F.lit("different vector dimensions")))
    out = cells.groupBy(*keys).agg(value.alias("__v")) if keys else cells.agg(F.when(F.count(F.lit(1)) > 0, value).alias("__v"))
    if not keys:
        return out
    groups = rows.select(*keys).distinct()
    on = [F.col(f"g.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    return groups.alias("g").join(out.alias("o"), on, "left").select(*[F.col(f"g.{k}") for k in keys], "__v")


def vector_avg(df: DataFrame, vector: str, keys: list[str] | None = None, out: str = "avg") -> DataFrame:
    """keys and the mean vector of each group; without keys one row, null for an empty table."""
    r = _by_element(df, keys or [], vector, F.avg)
    return r.select(*(keys or []), F.transform("__v", lambda x: x.cast("float")).alias(out))


def vector_sum(df: DataFrame, vector: str, keys: list[str] | None = None, out: str = "sum") -> DataFrame:
    """keys and the sum vector of each group; a sum outside float range is an error."""
    r = _by_element(df, keys or [], vector, F.sum)
    f = F.transform("__v", lambda x: x.cast("float"))
    bad = F.exists(f, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return r.select(*(keys or []), F.when(bad, F.raise_error(F.lit("value out of range: overflow"))).otherwise(f).alias(out))
