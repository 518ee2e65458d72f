"""Deterministic records in closed form, one day per file, for tests and examples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Periods in seconds, ranges, and the dates the cycles count from.
PERIODS = {"lt": 5820, "lon": 6240, "angle": 5820}
RANGES = {"lt": (0.0, 24.0), "lon": (0.0, 360.0), "angle": (0.0, 2 * math.pi)}
CYCLE_ORIGIN, ORBIT_ORIGIN = "2009-01-01", "2008-01-01"


def _cycle(t0: Column | int, s: Column, kind: str) -> Column:
    p, (lo, hi) = PERIODS[kind], RANGES[kind]
    return F.pmod(F.pmod(F.lit(t0), F.lit(p)) + s, F.lit(p)) * ((hi - lo) / p) + lo


def seconds_between(first: str, second: str) -> int:
    import pandas as pd

    return int((pd.Timestamp(second) - pd.Timestamp(first)).total_seconds())


def satellite(spark: SparkSession, first_day: str, days: int = 1, samples: int = 86_400) -> DataFrame:
    """A satellite with one sample a second: the first ``samples`` of each of ``days`` days from ``first_day`` on."""
    since, orbits = seconds_between(CYCLE_ORIGIN, first_day), seconds_between(ORBIT_ORIGIN, first_day)
    n = spark.range(days * samples)
    s = F.floor(F.col("id") / samples) * 86_400 + F.col("id") % samples
    base = n.select(F.timestamp_add("SECOND", s, F.lit(first_day).cast("timestamp_ntz")).alias("epoch"), s.alias("s"))
    cols = base.select(
        "epoch",
        F.pmod("s", F.lit(86_400)).cast("double").alias("uts"),
        _cycle(since, F.col("s"), "lt").alias("mlt"),
        _cycle(since + 20, F.col("s"), "lt").alias("slt"),
        _cycle(since, F.col("s"), "lon").alias("longitude"),
        (90.0 * F.cos(_cycle(since, F.col("s"), "angle"))).alias("latitude"),
        F.lit(400.0).alias("altitude"),
        F.floor((F.col("s") + orbits) / 5820).cast("long").alias("orbit_num"),
        F.col("s").cast("double").alias("dummy4"),
    )
    cols = cols.withColumns({"dummy1": F.col("mlt").cast("long"), "dummy2": (F.col("longitude") / 15).cast("long")})
    return cols.withColumns({"dummy3": (F.col("dummy1") + 1000 * F.col("dummy2")).cast("double"), "string_dummy": F.lit("test"), "unicode_dummy": F.lit("test"), **{f"int{n}_dummy": F.lit(1).cast(kind) for n, kind in ((8, "byte"), (16, "short"), (32, "int"), (64, "long"))}})


def imager(spark: SparkSession, first_day: str, days: int = 1, samples: int = 864, size: int = 7, height: int = 5) -> DataFrame:
    """The satellite every 100 seconds with nested variables: profiles with and without own heights, images (size x size) with their coordinates."""
    flat = satellite(spark, first_day, days, 86_400).where(F.col("dummy4") % 100 == 0).where(F.col("uts") / 100 < samples)
    value, steps = F.col("dummy3"), F.array(*[F.lit(float(i)) for i in range(size)])
    return flat.withColumns(
        {
            "profiles": F.array_repeat(value, height),
            "variable_profiles": F.array_repeat(value, height),
            "variable_profile_height": F.array(*[F.lit(float(i)) for i in range(height)]),
            "images": F.array_repeat(F.array_repeat(value, size), size),
            "image_lat": F.array_repeat(steps, size),
            "image_lon": F.array_repeat(steps, size),
        }
    )


def model_grid(spark: SparkSession, day: str) -> DataFrame:
    """A model field in long form: every 15 minutes on latitudes by 5 and longitudes by 5 degrees."""
    times = spark.range(96).select((F.col("id") * 900).alias("uts"))
    lat = spark.range(21).select((F.col("id") * 5.0 - 50).alias("latitude"))
    lon = spark.range(72).select((F.col("id") * 5.0).alias("longitude"))
    axes = times.crossJoin(F.broadcast(lat)).crossJoin(F.broadcast(lon))  # the axes of one day's grid, not data
    local = F.pmod(F.col("uts") / 3600.0 + F.col("longitude") / 15.0, F.lit(24.0))
    return axes.select(
        F.timestamp_add("SECOND", F.col("uts"), F.lit(day).cast("timestamp_ntz")).alias("epoch"), "latitude", "longitude", local.alias("slt"), F.pmod(local + 0.2, F.lit(24.0)).alias("mlt"),
        F.pmod(F.col("uts") * F.col("latitude") * F.col("longitude"), F.lit(21.0)).alias("dummy1"),
    )


def model_heights(spark: SparkSession, day: str) -> DataFrame:
    """The model field on 41 altitudes from 300 to 500 as well, which ``dummy2`` depends on."""
    out = model_grid(spark, day).withColumn("altitude", F.explode(F.array(*[F.lit(300.0 + 5 * i) for i in range(41)])))
    return out.withColumn("dummy2", F.pmod(F.col("dummy1") * F.col("altitude"), F.lit(21.0)))


def model_levels(spark: SparkSession, day: str) -> DataFrame:
    """A model every hour on 57 pressure levels, 72 latitudes and 144 longitudes: altitude (cm) and a drift that grows with the level."""
    level, hour, row, column = (F.col(c) for c in ("level", "hour", "row", "column"))
    n = spark.range(24 * 57 * 72 * 144).select(
        F.floor(F.col("id") / (57 * 72 * 144)).alias("hour"), F.floor(F.col("id") / (72 * 144)).alias("level"), F.floor(F.col("id") / 144).alias("row"), (F.col("id") % 144).alias("column")
    )
    slope = (F.pmod(row, F.lit(72)) / 71.0) * (column / 143.0)
    level = F.pmod(level, F.lit(57))
    return n.select(
        F.timestamp_add("HOUR", hour, F.lit(day).cast("timestamp_ntz")).alias("epoch"), (F.pmod(row, F.lit(72)) * 2.5 - 88.75).alias("latitude"), (column * 2.5 - 180).alias("longitude"),
        (level * 0.25 - 6.875).alias("ilev"), ((level * 10.0 + hour + slope) * 100_000).alias("altitude"), (2.0 * level * (F.sin(2 * math.pi * hour / 24) + slope)).alias("dummy_drifts"),
    )


def unordered(df: DataFrame) -> DataFrame:
    """Rows 3 to 5 of each day change places with rows 6 to 8, in ``file_row``."""
    n = F.hour("epoch") * 3600 + F.minute("epoch") * 60 + F.second("epoch")
    return df.withColumn("file_row", F.when(n.between(3, 5), n + 3).when(n.between(6, 8), n - 3).otherwise(n))
