"""Scalar functions of time, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SECONDS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0}


def year_and_doy(t: Column) -> Column:
    """Struct of year and day of year."""
    return F.struct(F.year(t).alias("year"), F.dayofyear(t).alias("doy"))


def seconds_of_day(t: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", day_of(t), t.cast("timestamp_ntz")) / 1e6


def decimal_year(t: Column) -> Column:
    """Year plus the elapsed share of it; leap years have 366 days."""
    days = F.dayofyear(F.make_date(F.year(t), F.lit(12), F.lit(31)))
    return F.year(t) + (F.dayofyear(t) - 1 + seconds_of_day(t) / 86400.0) / days


def parse_parts(year, month, day, hour="0", minute="0", second="0", century: int = 2000) -> Column:
    """A timestamp from texts of its parts; a two-digit year counts from ``century``; null where it is no date."""
    y = F.when(F.length(year) == 2, F.col(year).try_cast("int") + century).otherwise(F.col(year).try_cast("int"))
    part = lambda c: (F.lit(c) if str(c).isdigit() else F.col(c)).try_cast("int")
    return F.try_make_timestamp_ntz(y, part(month), part(day), part(hour), part(minute), part(second))


def from_parts(year: Column, day: Column, month: Column | None = None, uts: Column | None = None) -> Column:
    """Timestamp from year, month and day, or from year and day of year where ``month`` is None; ``uts``: seconds of day."""
    first = F.make_date(year.cast("int"), (F.lit(1) if month is None else month).cast("int"), F.lit(1))
    date = F.date_add(first, day.cast("int") - 1).cast("timestamp_ntz")
    if uts is None:
        return date
    return F.timestamp_add("MICROSECOND", F.round(uts * 1e6).cast("long"), date)


def day_of(t: Column) -> Column:
    """Midnight of the day, without a time zone."""
    return t.cast("date").cast("timestamp_ntz")


def frequency_seconds(freq: str) -> float:
    """Seconds of a frequency such as ``2h``, ``s`` or ``30min``."""
    m = re.fullmatch(r"\s*(\d*\.?\d*)\s*([A-Za-z]+)\s*", freq)
    unit = m and {"D": "d", "H": "h", "T": "min", "L": "ms", "U": "us", "N": "ns", "S": "s"}.get(m[2], m[2].lower())
    if not m or unit not in _SECONDS:
        raise ValueError(f"not a frequency: {freq!r}")
    return float(m[1] or 1) * _SECONDS[unit]


def frequency_text(seconds: Column) -> Column:
    """Whole seconds as ``{n}s``, else nanoseconds as ``{n}ns``."""
    return F.when(seconds == F.floor(seconds), F.format_string("%ds", seconds.cast("long"))).otherwise(F.format_string("%dns", F.round(seconds * 1e9).cast("long")))


def resolution(df: DataFrame, time: str, *keys: str, mean: bool = False) -> DataFrame:
    """Least (or mean) seconds between successive times, by ``keys``; null for fewer than two times.

    The mean needs no order: it is the range over the number of steps. The least step needs the neighbours, so give
    keys (instrument, day) that spread the window.
    """
    from pyspark.sql.window import Window

    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time))
    if mean:
        spread = (F.max(micros) - F.min(micros)) / 1e6 / F.nullif(F.count(time) - 1, F.lit(0))
        return df.groupBy(*keys).agg(spread.alias("resolution"))
    step = micros - F.lag(micros).over(Window.partitionBy(*keys).orderBy(time))
    return df.select(*keys, (step / 1e6).alias("__step")).groupBy(*keys).agg(F.min("__step").alias("resolution"))


def least_step(df: DataFrame, time: str) -> DataFrame:
    """One row: the least seconds between successive times of a whole record, null for fewer than two times.

    Neighbours meet inside a day, and what lies over midnight is told by the first and last time of each day, so no window holds a record.
    """
    from pyspark.sql.window import Window

    rows = df.where(F.col(time).isNotNull()).select(F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(time).cast("date").alias("day"))
    inside = rows.select("day", "t", (F.col("t") - F.lag("t").over(Window.partitionBy("day").orderBy("t"))).alias("step"))
    days = inside.groupBy("day").agg(F.min("step").alias("step"), F.min("t").alias("first"), F.max("t").alias("last"))
    # one row for each day
    over = F.col("first") - F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("day"))
    return days.select(F.least("step", over).alias("step")).agg((F.min("step") / 1e6).alias("resolution"))


def median_step(df: DataFrame, variable: str, *keys: str, order: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """Median of the differences of successive values by ``keys`` (instrument and day, as a rule); missing values give no difference."""
    from pyspark.sql.window import Window

    c = F.col(variable).cast("double")
    value = F.when(~F.isnan(c), c)
    step = value - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.select(*keys, step.alias("__step")).groupBy(*keys).agg(F.median("__step").alias("median_step"))


def at_most_daily(cadence: str) -> bool:
    """Whether files of a cadence such as ``1D`` or ``90min`` come each day or more often; months and years do not."""
    m = re.fullmatch(r"\s*\d*\s*([A-Za-z]+)\s*", cadence)
    if m and m[1] in ("MS", "M", "ME", "YS", "Y", "YE", "AS", "A", "W"):
        return False
    return frequency_seconds(cadence) <= 86400.0


def today(days: int = 0) -> Column:
    """Midnight of today in UTC (the session's zone), or of so many days later."""
    return F.date_add(F.current_date(), days).cast("timestamp_ntz")


def epoch_decode(number: Column, unit: str = "ms", origin: str = "unix") -> Column:
    """Timestamps from numbers of ``unit`` since ``origin`` (``unix``, ``julian`` or a timestamp text)."""
    if origin == "julian":
        return F.timestamp_add("MICROSECOND", F.round((number - 2440587.5) * 86400e6).cast("long"), F.lit("1970-01-01").cast("timestamp_ntz"))
    start = "1970-01-01" if origin == "unix" else origin
    return F.timestamp_add("MICROSECOND", F.round(number * _SECONDS[unit] * 1e6).cast("long"), F.lit(start).cast("timestamp_ntz"))


def epoch_encode(t: Column) -> Column:
    """Whole milliseconds since 1970; what is left of one goes, towards 1970."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t)
    return F.call_function("div", micros, F.lit(1000).cast("long"))


def date_range(start: str, stop: str, step: str = "1 day") -> Column:
    """Array of timestamps from start to stop, both included."""
    return F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz"), F.expr(f"interval {step}"))
