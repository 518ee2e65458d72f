"""Nested variables: between one row per time with arrays, and long rows with one value each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, variable: str, dims: Sequence[str], *keys: str) -> DataFrame:
    """One row per element: ``keys``, an index per dimension (from 0) and ``value``."""
    # the outer form gives null and empty arrays a row without an index, which goes; before the inner one Spark would put a filter that
    # evaluates the variable, however dear, twice more
    out = df.select(*keys, F.posexplode_outer(variable).alias(dims[0], "value")).where(F.col(dims[0]).isNotNull())
    for d in dims[1:]:
        out = out.select(*[c for c in out.columns if c != "value"], F.posexplode_outer("value").alias(d, "value")).where(F.col(d).isNotNull())
    return out


def to_nested(long: DataFrame, dims: Sequence[str], name: str, *keys: str) -> DataFrame:
    """The inverse, dimension by dimension from the innermost; missing places close up."""
    out = long.withColumnRenamed("value", name)
    for i in range(len(dims) - 1, -1, -1):
        rows = F.sort_array(F.collect_list(F.struct(dims[i], name)))
        out = out.groupBy(*keys, *dims[:i]).agg(F.transform(rows, lambda r: r[name]).alias(name))
    return out


def element(df: DataFrame, variable: str, *at: int):
    """The element of a nested variable at indices from 0; null beyond its size."""
    c = F.col(variable)
    for i in at:
        c = F.get(c, F.lit(i))
    return c


def equal_sizes(df: DataFrame, variable: str, fill) -> DataFrame:
    """Fills each row's array up to the longest; one small aggregate finds its size."""
    size = df.agg(F.max(F.size(variable))).first()[0] or 0
    padded = F.concat(variable, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(size) - F.size(variable))).cast(df.schema[variable].dataType))
    return df.withColumn(variable, padded)
