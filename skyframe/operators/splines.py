"""Interpolating splines of a record on a grid, in blocks with a halo.

A spline through all points of a record is one banded system, but what a point adds to the solution falls by half or more with each
point in between. So a block is solved with the points around it, and where it is cut shows less than the last digit of a double.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyframe.operators import blocks

#: Points that a block owns, points solved at once inside it, and points that are looked at beyond both ends.
BLOCK_ROWS, PART_ROWS, HALO = 4096, 256, 80
MOST_ORDER = 5


def _knots(x: np.ndarray, k: int) -> np.ndarray:
    """Not-a-knot: points (odd order) or their midpoints (even order), without as many as an order needs at both ends."""
    inner = x if k % 2 else (x[1:] + x[:-1]) / 2
    cut = (k + 1) // 2
    return np.concatenate([np.full(k + 1, x[0]), inner[cut : len(inner) - cut], np.full(k + 1, x[-1])])


def _basis(knots: np.ndarray, k: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the first basis function that is not zero at each ``x``, and the values of it and the k behind it."""
    at = np.clip(np.searchsorted(knots, x, "right") - 1, k, len(knots) - k - 2)
    values = np.ones((len(x), 1))
    for d in range(1, k + 1):
        low, high = knots[at[:, None] + np.arange(1 - d, 1)], knots[at[:, None] + np.arange(1, d + 1)]
        share = values / (high - low)
        grown = np.zeros((len(x), d + 1))
        grown[:, :d] = share * (high - x[:, None])
        grown[:, 1:] += share * (x[:, None] - low)
        values = grown
    return at - k, values


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The not-a-knot spline of order ``k`` through points with ascending ``x``, at places between them."""
    scale = (x[-1] - x[0]) or 1.0
    u, w = (x - x[0]) / scale, (at - x[0]) / scale
    knots = _knots(u, k)
    first, values = _basis(knots, k, u)
    matrix = np.zeros((len(x), len(x)))
    matrix[np.arange(len(x))[:, None], first[:, None] + np.arange(k + 1)] = values
    weights = np.linalg.solve(matrix, y)
    first, values = _basis(knots, k, w)
    return (weights[first[:, None] + np.arange(k + 1)] * values).sum(axis=1)


def interpolated(grid: DataFrame, data: DataFrame, values: Sequence[str], order: int, *keys: str, time: str = "epoch") -> DataFrame:
    """``grid`` with ``values`` on the spline of ``order`` (2: quadratic, 3: cubic, at most 5) through the rows of ``data`` that have them.

    Of rows with equal times the greatest value counts; missing values are passed over. Outside of a variable's record, and where it has no more
    points than the order, there is nothing to interpolate: null. Splines beyond the third order through very uneven times
    carry far; blocks meet there less exactly.
    """
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"splines have orders from 1 to {MOST_ORDER}")
    known = [F.struct(F.lit(v).alias("variable"), F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double")).alias("y")) for v in values]
    points = data.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("epoch"), F.inline(F.array(*known))).where("y IS NOT NULL")
    points = points.groupBy(*keys, "epoch", "variable").agg(F.max("y").alias("y"))
    asked = grid.where("epoch IS NOT NULL").select(*keys, "epoch", F.explode(F.array(*[F.lit(v) for v in values])).alias("variable"), F.lit(None).cast("double").alias("y"))
    both = blocks.keyed(points.unionByName(asked), [*keys, "variable"], "epoch").withColumn("__point", F.col("y").isNotNull().cast("long"))
    days = both.groupBy(blocks.KEY, blocks.DAY).agg(F.sum("__point").alias("n"))
    along = Window.partitionBy(blocks.KEY).orderBy(blocks.DAY).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(blocks.KEY, blocks.DAY, F.coalesce(F.sum("n").over(along), F.lit(0)).alias("__before"), F.sum("n").over(Window.partitionBy(blocks.KEY)).alias("__all"))
    # a place on the grid has the number of the last point at or before it
    so_far = Window.partitionBy(blocks.KEY, blocks.DAY).orderBy("epoch", F.desc("__point")).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.join(days, [blocks.KEY, blocks.DAY]).withColumn(blocks.RANK, F.col("__before") + F.sum("__point").over(so_far) - 1)
    inside = placed.where((F.col("__all") > order) & (F.col(blocks.RANK) >= 0)).drop("__before", "__all", blocks.DAY)
    halo = blocks.with_halo(inside, BLOCK_ROWS, HALO).where(F.col(blocks.OWN) | (F.col("__point") == 1))
    dealt = halo.select(*keys, "variable", F.unix_micros(F.col("epoch").cast("timestamp")).alias("t"), "y", "__point", blocks.RANK, blocks.BLOCK, blocks.KEY)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["t", "__point"], ascending=[True, False])
        point = part["__point"].to_numpy() == 1
        x, y = part["t"].to_numpy()[point], part["y"].to_numpy()[point]
        wanted = part[~point]
        at, of = wanted["t"].to_numpy(), wanted[blocks.RANK].to_numpy() - int(part[blocks.RANK].to_numpy()[point].min())
        got = np.full(len(at), np.nan)
        for low in range(0, len(x), PART_ROWS):
            mine = (of >= low) & (of < low + PART_ROWS) & (at <= x[-1])
            if mine.any():
                a, b = max(0, low - HALO), min(len(x), low + PART_ROWS + HALO)
                got[mine] = spline((x[a:b] - x[a]).astype(float), y[a:b], (at[mine] - x[a]).astype(float), order)
        return wanted[[*keys, "variable", "t"]].assign(y=got)

    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    solved = dealt.groupBy(blocks.KEY, blocks.BLOCK).applyInPandas(solve, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "variable string, t long, y double"]))
    solved = solved.where("NOT isnan(y)").select(*keys, F.timestamp_micros("t").cast("timestamp_ntz").alias("epoch"), "variable", "y")
    wide = solved.groupBy(*keys, "epoch").agg(*[F.max(F.when(F.col("variable") == v, F.col("y"))).alias(v) for v in values])
    on = [grid[c].eqNullSafe(wide[c]) for c in keys] + [grid["epoch"] == wide["epoch"]]
    return grid.join(wide, on, "left").select(*[grid[c] for c in (*keys, "epoch")], *[wide[v] for v in values])
