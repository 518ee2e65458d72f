"""Small helpers for values of arguments and columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def listed(x) -> list:
    """One value or many as a flat list; None is no value, a text or bytes are one."""
    if x is None:
        return []
    if isinstance(x, (str, bytes)) or not isinstance(x, Iterable):
        return [x]
    return [y for item in x for y in listed(item)] if not isinstance(x, Mapping) else list(x)


def texts(df: DataFrame, *names: str) -> DataFrame:
    """Binary columns (all of them without names) as UTF-8 texts, arrays of them too; others stay."""

    def text(c: Column, kind: T.DataType) -> Column | None:
        if isinstance(kind, T.BinaryType):
            return F.decode(c, "UTF-8")
        if isinstance(kind, T.ArrayType) and text(F.lit(None), kind.elementType) is not None:
            return F.transform(c, lambda x: text(x, kind.elementType))
        return None

    found = {f.name: text(F.col(f.name), f.dataType) for f in df.schema if not names or f.name in names}
    return df.withColumns({n: c for n, c in found.items() if c is not None})


def mapped(value, mapper: Mapping | Callable):
    """What a mapping has for a value, or what a function makes of it; None where the mapping has nothing."""
    return mapper(value) if callable(mapper) else mapper.get(value)


#: One letter for what the values of a column are.
TYPE_CODES = ((T.BooleanType, "b"), (T.IntegralType, "i"), (T.FractionalType, "f"), (T.StringType, "U"), (T.BinaryType, "S"), ((T.TimestampType, T.TimestampNTZType, T.DateType), "M"))


def type_code(kind: T.DataType) -> str:
    """Of a nested type that of its elements; ``O`` for structs, maps and whatever else."""
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return next((code for types, code in TYPE_CODES if isinstance(kind, types)), "O")
