"""Selection, assignment, renaming and concatenation of records."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def at_positions(df: DataFrame, start: int, stop: int, *keys: str, order: Sequence[str] = ("epoch",)) -> DataFrame:
    """Rows ``[start, stop)`` by position within each partition of ``keys``."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("__n", n).where((F.col("__n") >= start) & (F.col("__n") < stop)).drop("__n")


def between(df: DataFrame, start: str, stop: str, columns: Sequence[str] | None = None, time: str = "epoch") -> DataFrame:
    """Rows from ``start`` to ``stop``, both included; the filter reaches the scan."""
    t = F.col(time)
    found = df.where((t >= F.lit(start).cast("timestamp_ntz")) & (t <= F.lit(stop).cast("timestamp_ntz")))
    return found.select(*columns) if columns else found


def column_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """All columns from one to the other in the schema's order, both included."""
    i, j = df.columns.index(first), df.columns.index(last)
    return df.select(*df.columns[i : j + 1])


def every(df: DataFrame, step: int, *keys: str, order: Sequence[str] = ("epoch",)) -> DataFrame:
    """Each ``step``-th row of every partition, from the first on."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("__n", n).where(F.col("__n") % step == 0).drop("__n")


def assign(df: DataFrame, name: str, value: Column, where: Column | None = None, metadata: dict | None = None) -> DataFrame:
    """Sets a column, or its rows that meet ``where``; the column's metadata is kept or replaced."""
    held = metadata if metadata is not None else (df.schema[name].metadata if name in df.columns else {})
    if where is not None:
        value = F.when(where, value).otherwise(F.col(name) if name in df.columns else F.lit(None))
    out = df.withColumn(name, value)
    return out.withMetadata(name, held) if held else out


def drop(df: DataFrame, names: str | Sequence[str]) -> DataFrame:
    """Drops columns: KeyError if none of them is there, a warning if some are not."""
    names = [names] if isinstance(names, str) else list(names)
    there = [n for n in names if n in df.columns]
    if not there:
        raise KeyError(f"no such columns: {names}")
    if len(there) < len(names):
        warnings.warn(f"not found: {sorted(set(names) - set(there))}", stacklevel=2)
    return df.drop(*there)


def rename(df: DataFrame, mapper: Mapping[str, str] | Callable[[str], str], *, lowercase: bool = False) -> DataFrame:
    """Renames columns; unknown names are a ValueError. With ``lowercase`` the given case stays in ``display_name``."""
    if callable(mapper):
        mapper = {c: mapper(c) for c in df.columns}
    if unknown := [k for k in mapper if k not in df.columns]:
        raise ValueError(f"no such columns: {unknown}")
    out = df
    for old, new in mapper.items():
        meta = df.schema[old].metadata
        if lowercase and new != new.lower():
            meta, new = meta | {"display_name": new}, new.lower()
        out = out.withColumnRenamed(old, new)
        if meta:
            out = out.withMetadata(new, meta)
    return out


def without_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Removes everything up to the last occurrence of ``prefix`` in each column's name."""
    return rename(df, {c: c.rpartition(prefix)[2] for c in df.columns if prefix in c})


def concat(*parts: DataFrame, start: str | None = None, stop: str | None = None, time: str = "epoch") -> DataFrame:
    """All rows of all parts; columns that a part lacks are null. With ``start`` or ``stop`` only rows of that range, the stop excluded, are taken."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if start is not None:
        out = out.where(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    return out if stop is None else out.where(F.col(time) < F.lit(stop).cast("timestamp_ntz"))


def assign_values(df: DataFrame, name: str, values: Sequence, dims: Sequence[int] = ()) -> DataFrame:
    """Sets a column to one nested value for all rows; no values give missing ones and a warning, another shape than ``dims`` is a ValueError."""
    if not len(values):
        warnings.warn(f"{name} has no values", stacklevel=2)
        return df.withColumn(name, F.lit(float("nan")))

    def shape(x) -> tuple[int, ...]:
        if not isinstance(x, (list, tuple)):
            return ()
        inner = {shape(i) for i in x}
        if len(inner) > 1:
            raise ValueError(f"{name} is ragged")
        return (len(x), *next(iter(inner), ()))

    if dims and shape(values) != tuple(dims):
        raise ValueError(f"{name} has the shape {shape(values)}, not {tuple(dims)}")
    return df.withColumn(name, F.lit(values))


def variables(df: DataFrame, time: str = "epoch") -> list[str]:
    """All columns but the time."""
    return [c for c in df.columns if c.lower() != time.lower()]


def same(one: DataFrame, other: DataFrame) -> bool:
    """Whether two tables have the same columns, types, column metadata and rows, in any order; rows that repeat count."""
    kinds = [sorted((f.name, f.dataType.simpleString(), str(sorted(f.metadata.items()))) for f in x.schema) for x in (one, other)]
    if kinds[0] != kinds[1]:
        return False
    other = other.select(*one.columns)
    tally = [x.groupBy(*x.columns).agg(F.count(F.lit(1)).alias("__n")) for x in (one, other)]
    return tally[0].exceptAll(tally[1]).isEmpty() and tally[1].exceptAll(tally[0]).isEmpty()


def time_problems(df: DataFrame, *keys: str, time: str = "epoch", order: Sequence[str] = ()) -> DataFrame:
    """Per partition: how many times are repeated, and how many rows lie before the row that precedes them in file order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    back = (F.col(time) < F.lag(time).over(w)).cast("int")
    marked = df.select(*keys, F.col(time).alias("__t"), back.alias("__back"))
    return marked.groupBy(*keys).agg((F.count("__t") - F.countDistinct("__t")).alias("repeated"), F.coalesce(F.sum("__back"), F.lit(0)).alias("backwards"))
