"""Alignment of records on a common time grid: exact, forward, backward, nearest, zero, linear and by splines.

Neighbours are found inside partitions of keys and day; what a day needs from the days before and after it comes from
one summary row per day. So no window spans a whole record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyframe.operators import splines

#: Splines by name.
ORDERS = {"quadratic": 2, "cubic": 3}


def time_grid(df: DataFrame, step: str, *keys: str, time: str = "epoch", common: DataFrame | None = None) -> DataFrame:
    """A regular grid of ``epoch`` over each key's range, or over the range of ``common`` for every key."""
    ends = df.groupBy(*keys).agg(F.min(time).alias("__a"), F.max(time).alias("__b"))
    return ends.select(*keys, F.explode(F.sequence("__a", "__b", F.expr(f"interval {step}"))).alias("epoch"))


def shared_range(members: Sequence[DataFrame], *, overlap: bool, time: str = "epoch") -> tuple:
    """First and last time of the overlap or hull of all members that have rows; one row per member reaches the driver.

    ``(None, None)`` where no member has rows or nothing overlaps.
    """
    ends = [e for e in (m.agg(F.min(time), F.max(time)).first() for m in members) if e[0] is not None]
    if not ends:
        return None, None
    low = (max if overlap else min)(e[0] for e in ends)
    high = (min if overlap else max)(e[1] for e in ends)
    return (low, high) if low <= high else (None, None)


def neighbours(grid: DataFrame, data: DataFrame, values: Sequence[str], *keys: str, time: str = "epoch") -> DataFrame:
    """Grid rows with ``prev`` and ``next``: structs of the time and values of the data rows at or before and at or after.

    Of data rows with equal times the one with the greatest values counts.
    """
    row = F.struct(F.col(time).alias("t"), *[F.col(v) for v in values])
    held = data.groupBy(*keys, time).agg(F.max(row).alias("row")).withColumn("day", F.col(time).cast("date"))
    days = held.groupBy(*keys, "day").agg(F.max("row").alias("last"), F.min("row").alias("first"))
    asked = grid.withColumn("day", F.col("epoch").cast("date"))
    # every day that has rows or grid points, with what the days before and after it leave: one row per key and day
    # what lies ahead is found by the reverse order: a frame up to the end of a partition is read anew for every row, in time quadratic in its rows
    so_far = Window.unboundedPreceding
    by_day = Window.partitionBy(*keys)
    every = asked.select(*keys, "day").distinct().join(days, [*keys, "day"], "full")
    carried = every.select(
        *keys,
        "day",
        F.last("last", ignorenulls=True).over(by_day.orderBy("day").rowsBetween(so_far, -1)).alias("before"),
        F.last("first", ignorenulls=True).over(by_day.orderBy(F.desc("day")).rowsBetween(so_far, -1)).alias("after"),
    )
    kind = held.schema["row"].dataType.simpleString()
    both = held.select(*keys, "day", F.col(time).alias("epoch"), "row", F.lit(False).alias("asks")).unionByName(
        asked.select(*keys, "day", "epoch", F.lit(None).cast(kind).alias("row"), F.lit(True).alias("asks"))
    )
    w = Window.partitionBy(*keys, "day")
    found = both.select(
        "*",
        F.last("row", ignorenulls=True).over(w.orderBy("epoch", "asks").rowsBetween(so_far, 0)).alias("p"),
        F.last("row", ignorenulls=True).over(w.orderBy(F.desc("epoch"), "asks").rowsBetween(so_far, 0)).alias("n"),
    ).where("asks")
    joined = found.join(carried, [*keys, "day"], "left")
    return joined.select(*keys, "epoch", F.coalesce("p", "before").alias("prev"), F.coalesce("n", "after").alias("next"))


def align(grid: DataFrame, data: DataFrame, values: Sequence[str], method: str | None, *keys: str, time: str = "epoch", fills: dict | None = None, limit: str | None = None, limit_rows: int | None = None, order: int | None = None) -> DataFrame:
    """``grid`` with ``values`` by ``method``: None (equal times only), ffill, bfill, nearest, zero, linear (slinear), quadratic, cubic or polynomial.

    ``fills``: what unmatched grid rows get instead of null with equal times. Nearest prefers the earlier row of two
    equally far ones. Zero is the row before, and like linear needs rows on both sides. Polynomial is a spline of ``order``; splines pass
    over missing values, see :func:`skyframe.operators.splines.interpolated`. ``limit``: the rows used may be that far away at most; splines use them all. ``limit_rows``: ffill and bfill
    serve so many grid rows beyond each data row at most.
    """
    if method in ORDERS or method == "polynomial":
        if limit or limit_rows:
            raise ValueError("splines have no limit")
        if method == "polynomial" and order is None:
            raise ValueError("a polynomial needs an order")
        return splines.interpolated(grid, data, values, ORDERS.get(method, order), *keys, time=time)
    if method is None:
        matched = data.select(*keys, F.col(time).alias("epoch"), *values, F.lit(True).alias("__hit"))
        joined = grid.join(matched, [*keys, "epoch"], "left")
        fill = fills or {}
        return joined.select(*keys, "epoch", *[F.when(F.col("__hit"), F.col(v)).otherwise(F.lit(fill.get(v))).alias(v) for v in values])
    near = neighbours(grid, data, values, *keys, time=time)
    if limit:
        far = F.expr(f"interval {limit}")
        near = near.withColumns({"prev": F.when(F.col("prev.t") + far >= F.col("epoch"), F.col("prev")), "next": F.when(F.col("next.t") - far <= F.col("epoch"), F.col("next"))})
    if limit_rows is not None:
        side = {"ffill": "prev", "pad": "prev", "bfill": "next", "backfill": "next"}.get(method)
        if side is None:
            raise ValueError("only ffill and bfill are limited in rows")
        # places on the grid that one data row serves, the nearest first; one at its very time does not count
        served = Window.partitionBy(*keys, f"{side}.t").orderBy(F.col("epoch") if side == "prev" else F.desc("epoch"))
        beyond = F.col(side).isNotNull() & (F.col("epoch") != F.col(f"{side}.t"))
        near = near.withColumn("__served", F.sum(beyond.cast("int")).over(served.rowsBetween(Window.unboundedPreceding, 0)))
        near = near.withColumn(side, F.when(~beyond | (F.col("__served") <= limit_rows), F.col(side))).drop("__served")
    micros = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
    back, ahead = micros(F.col("prev.t"), F.col("epoch")), micros(F.col("epoch"), F.col("next.t"))

    def pick(v: str) -> Column:
        p, n = F.col(f"prev.{v}"), F.col(f"next.{v}")
        if method in ("ffill", "pad"):
            return p
        if method in ("bfill", "backfill"):
            return n
        if method == "nearest":
            return F.when(F.col("next").isNull() | (F.col("prev").isNotNull() & (back <= ahead)), p).otherwise(n)
        if method == "zero":
            return F.when(F.col("next").isNotNull(), p)
        if method in ("linear", "slinear"):
            span = back + ahead
            return F.when(span == 0, p.cast("double")).otherwise(p + (n - p) * back / F.nullif(span, F.lit(0)))
        raise ValueError(f"unknown method {method!r}")

    return near.select(*keys, "epoch", *[pick(v).alias(v) for v in values])
