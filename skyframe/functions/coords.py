"""Coordinates, units and fill values, as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.meta import KEY, Meta

# How many of each unit make one of the base unit of its kind. Densities too are counted physically: one
# per cubic centimetre is 1e6 per cubic metre, so a number in m-3 is 1e-6 of itself in cm-3.
UNITS = {
    "angle": {"deg": 180.0, "rad": math.pi, "h": 12.0, "hours": 12.0},
    "length": {"m": 1.0, "km": 0.001, "cm": 100.0},
    "speed": {"m/s": 1.0, "cm/s": 100.0, "km/s": 0.001},
    "density": {"m$^{-3}$": 1.0, "m-3": 1.0, "/m3": 1.0, "n/m3": 1.0, "cm$^{-3}$": 1e-6, "cm-3": 1e-6, "/cm3": 1e-6, "n/cm3": 1e-6, "n/cc": 1e-6, "km$^{-3}$": 1e9, "km-3": 1e9, "/km3": 1e9, "n/km3": 1e9},
}
_ALIASES = {"degree": "deg", "degrees": "deg", "radian": "rad", "radians": "rad", "hr": "h", "hrs": "h", "km s-1": "km/s", "m s-1": "m/s", "cm s-1": "cm/s"}


def unit_factor(out_unit: str, in_unit: str) -> float:
    """What a value in ``in_unit`` is multiplied by to be in ``out_unit``."""
    if out_unit == in_unit:
        return 1.0
    out_unit, in_unit = (_ALIASES.get(u.lower(), u.lower()) for u in (out_unit, in_unit))
    kinds = [next((k for k, v in UNITS.items() if u in v), None) for u in (out_unit, in_unit)]
    if None in kinds:
        raise ValueError(f"unknown unit {out_unit if kinds[0] is None else in_unit!r}")
    if kinds[0] != kinds[1]:
        raise ValueError(f"cannot scale {in_unit!r} to {out_unit!r}")
    return UNITS[kinds[0]][out_unit] / UNITS[kinds[0]][in_unit]


def wrap_once(x: Column, high: float = 360.0, low: float = 0.0) -> Column:
    """Moves values at or above ``high`` down and values below ``low`` up, by one range; no modulo."""
    y = F.when(x >= high, x - (high - low)).otherwise(x)
    return F.when(y < low, y + (high - low)).otherwise(y)


def with_longitude(df: DataFrame, name: str = "longitude", high: float = 180.0, low: float = -180.0) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"no column {name!r}")
    return df.withColumn(name, wrap_once(F.col(name), high, low))


def solar_local_time(t: Column, longitude: Column, *, modulus: bool = True, ref_date: str | None = None) -> Column:
    """Hours: universal time plus longitude / 15, modulo 24, or counted on from midnight of ``ref_date``."""
    from skyframe.functions.time import seconds_of_day

    hours = seconds_of_day(t) / 3600.0 + longitude / 15.0
    if modulus:
        return F.pmod(hours, F.lit(24.0))
    if ref_date is None:
        return hours
    return hours + 24.0 * F.datediff(t, F.lit(ref_date))


def replace_fill(df: DataFrame, fills: dict[str, float | None], new: float | str | None = None) -> DataFrame:
    """Replaces each column's fill value (NaN: missing values) by ``new``; other columns stay."""
    out = {}
    for name, old in fills.items():
        c = F.col(name)
        is_fill = (F.isnan(c) | c.isNull()) if isinstance(old, float) and math.isnan(old) else c == F.lit(old)
        out[name] = F.when(is_fill, F.lit(new).cast(df.schema[name].dataType)).otherwise(c)
    return df.withColumns(out)


def replace_labelled_fill(df: DataFrame, names: Sequence[str] | None = None, new: float | str | None = math.nan) -> DataFrame:
    """Replaces the fill values that columns' labels name (all labelled columns without ``names``) by ``new``, and says so in the labels.

    A column whose label names no fill stays. ``new`` is cast to the column's type; NaN is null where that is not floating.
    """
    meta = Meta.of(df)
    asked = [c for c in (df.columns if names is None else names) if (fill := df.schema[c].metadata.get(KEY, {}).get("fill")) is not None and fill != ""]
    out, said = df, {}
    for c in asked:
        kind = df.schema[c].dataType
        value = None if isinstance(new, float) and math.isnan(new) and not isinstance(kind, (T.DoubleType, T.FloatType)) else new
        out = replace_fill(out, {c: meta[c, "fill"]}, value)
        said[c] = meta[c] | {"fill": value}
    return Meta(said, meta.header).attach(out)


def common_axis(spans: list[tuple[float, float, int]], *, overlap: bool = True) -> list[float]:
    """One regular axis for several given as (low, high, number of points): their overlap or hull, at the finest mean step."""
    low = (max if overlap else min)(s[0] for s in spans)
    high = (min if overlap else max)(s[1] for s in spans)
    steps = [abs(b - a) / (n - 1) for a, b, n in spans if n > 1]
    if not steps or high < low:
        return [low] if high >= low else []
    n = int((high - low) / min(steps)) + 1
    return [low + i * (high - low) / (n - 1) for i in range(n)] if n > 1 else [low]


def pad_array(c: Column, size: int, fill) -> Column:
    """An array filled up to ``size`` elements."""
    return F.concat(c, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(size) - F.size(c))))
