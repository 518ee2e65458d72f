"""Nested variables on common axes: one axis for each dimension shared by several records, and re-gridding row by row.

A variable of several dimensions is a nested array, and each dimension has an axis: a column of ascending numbers, which may differ from row to row.
All of it is higher-order functions inside a row, so nothing is shuffled; rows are aligned in time by :mod:`skyframe.operators.align`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.functions.coords import common_axis
from skyframe.meta import Meta, default_fill

METHODS = (None, "nearest", "ffill", "pad", "bfill", "backfill", "linear")


def shared_axes(members: Sequence[DataFrame], axes: Sequence[str], *, overlap: bool = True) -> dict[str, list[float]]:
    """For each axis a regular one over the overlap (or hull) of all members' ranges, as fine as the finest; one row per member reaches the driver.

    Members and rows without an axis count for nothing; where nothing overlaps, the axis is empty.
    """
    ends = []
    for i, m in enumerate(members):
        for_axis = [F.struct(F.lit(x).alias("axis"), F.min(F.array_min(x)).cast("double").alias("low"), F.max(F.array_max(x)).cast("double").alias("high"), F.max(F.size(x)).alias("n")) for x in axes if x in m.columns]
        if for_axis:
            ends.append(m.agg(F.array(*for_axis).alias("ends")).select(F.lit(i).alias("member"), F.inline("ends")))
    # one job for all members and axes, so that what a member is made of is made once
    rows = reduce(DataFrame.unionByName, ends).collect() if ends else []
    found = {}
    for axis in axes:
        spans = [(r["low"], r["high"], r["n"]) for r in sorted(rows, key=lambda r: r["member"]) if r["axis"] == axis and r["low"] is not None]
        found[axis] = common_axis(spans, overlap=overlap) if spans else []
    return found


def _places(axis: Column, targets: Sequence[float], method: str | None) -> Column:
    """For each target the indices (from 0) of the elements used and the weight of the second; -1 where there is none."""

    def used(a: Column, b: Column, w: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), w.alias("w"))

    def chosen(t: Column, before: Column, above: Column) -> Column:
        none, nothing = F.lit(-1), F.lit(0.0)
        if method in ("ffill", "pad"):
            return used(before, before, nothing)
        if method in ("bfill", "backfill"):
            return used(above, above, nothing)
        left, right = F.get(axis, before), F.get(axis, above)
        if method == "nearest":
            near = F.when(above < 0, before).when(before < 0, above).when(t - left <= right - t, before).otherwise(above)
            return _let(near, lambda n: used(n, n, nothing))
        both = (before >= 0) & (above >= 0)
        weight = F.when(both & (right > left), (t - left) / (right - left)).otherwise(0.0)
        return used(F.when(both, before).otherwise(none), F.when(both, above).otherwise(none), weight)

    def place(t: Column) -> Column:
        here = F.array_position(axis, t).cast("int") - 1
        if method is None:
            return _let(here, lambda h: used(h, h, F.lit(0.0)))
        # the axis is searched once for each target: what is found is bound, as every mention of an expression in a lambda is evaluated anew
        found = F.struct(here.alias("here"), F.size(F.filter(axis, lambda x: x <= t)).alias("below"))

        def sides(f: Column) -> Column:
            exact = f["here"] >= 0
            above = F.when(exact, f["here"]).when(f["below"] < F.size(axis), f["below"]).otherwise(-1)
            return F.struct(F.when(exact, f["here"]).otherwise(f["below"] - 1).alias("before"), above.alias("above"))

        return _let(found, lambda f: _let(sides(f), lambda s: chosen(t, s["before"], s["above"])))

    return F.transform(F.array(*[F.lit(float(t)) for t in targets]).cast("array<double>"), place)


def _between(a: Column, b: Column, w: Column, rank: int) -> Column:
    """Elements of two arrays of ``rank`` further dimensions, the second weighted by ``w``."""
    if rank:
        return F.zip_with(a, b, lambda x, y: _between(x, y, w, rank - 1))
    return F.when(w == 0, a).otherwise(a + (b - a) * w)


def _filled(fill: Column, sizes: Sequence[int]) -> Column:
    for n in reversed(sizes):
        fill = F.array_repeat(fill, n)
    return fill


def _along(values: Column, places: Column, fill: Column, rank: int, blend: bool) -> Column:
    """An array of ``rank`` further dimensions moved to ``places`` in its first one."""

    def at(p: Column) -> Column:
        a, b = F.get(values, p["a"]), F.get(values, p["b"])
        return F.when(p["a"] >= 0, _between(a, b, p["w"], rank) if blend else a).otherwise(fill)

    return F.transform(places, at)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is found once, however often the body names it and wherever the optimizer moves the whole."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _inside(values: Column, depth: int, move: Callable[[Column], Column]) -> Column:
    return F.transform(values, lambda v: _inside(v, depth - 1, move)) if depth else move(values)


def _mover(sizes: Sequence[int], fill: Column, blend: bool) -> Callable[[Column], Column]:
    """Moves the ``values`` of a struct to its places ``p0`` and so on, one dimension after the other, the innermost first."""

    def outwards(env: Column, held: Column, k: int) -> Column:
        if k < 0:
            return held
        step = _inside(held, k, lambda v: _along(v, env[f"p{k}"], _filled(fill, sizes[k + 1 :]), len(sizes) - 1 - k, blend))
        return _let(step, lambda moved: outwards(env, moved, k - 1))

    return lambda env: outwards(env, env["values"], len(sizes) - 1)


def regrid(df: DataFrame, variables: Mapping[str, Sequence[str]], targets: Mapping[str, Sequence[float]], method: str | None = None, *, fills: Mapping[str, object] | None = None) -> DataFrame:
    """``df`` with nested ``variables`` (and the axes they lie along, from the outermost on) moved to ``targets``; other columns stay.

    ``method``: None (equal coordinates only), ffill, bfill, nearest (the lower of two equally far ones) or linear in each dimension; numbers become doubles by linear,
    and what is no number takes the nearest. Places that a method has no element for get the variable's fill: that of ``fills``, of its metadata or of its type, by linear null.
    A row without the variable or an axis keeps null. Axes become the targets where a variable has them.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    meta, out, moved = Meta.of(df), df, set()
    for name, dims in variables.items():
        kind: T.DataType = df.schema[name].dataType
        for d in dims:
            if not isinstance(kind, T.ArrayType):
                raise ValueError(f"{name} has fewer dimensions than {tuple(dims)}")
            kind = kind.elementType
            if d not in targets:
                raise ValueError(f"there is no target for the axis {d}")
        if isinstance(kind, T.ArrayType):
            raise ValueError(f"{name} has more dimensions than {tuple(dims)}")
        how = "nearest" if method == "linear" and not isinstance(kind, T.NumericType) else method
        values, blend = F.col(name), how == "linear"
        if blend:
            kind = T.DoubleType()
            for _ in dims:
                kind = T.ArrayType(kind)
            values, kind = values.cast(kind), T.DoubleType()
        held = default_fill(kind) if meta[name, "fill"] is None else meta[name, "fill"]
        fill = F.lit(None if blend else (fills or {}).get(name, held)).cast(kind)
        known = F.col(name).isNotNull()
        for d in dims:
            known = known & F.col(d).isNotNull()
        env = F.struct(values.alias("values"), *[_places(F.col(d).cast("array<double>"), targets[d], how).alias(f"p{i}") for i, d in enumerate(dims)])
        out = out.withColumn(f"__moved_{name}", F.when(known, _let(env, _mover([len(targets[d]) for d in dims], fill, blend))))
        moved.update(dims)
    axes = {d: F.when(F.col(d).isNotNull(), F.array(*[F.lit(float(t)) for t in targets[d]]).cast("array<double>")) for d in moved}
    out = out.withColumns({f"__axis_{d}": c for d, c in axes.items()})
    named = {**{v: f"__moved_{v}" for v in variables}, **{d: f"__axis_{d}" for d in moved}}
    return out.select(*[F.col(named.get(c, c)).alias(c) for c in df.columns])


def equal_sizes(df: DataFrame, variables: Sequence[str], *, fills: Mapping[str, object] | None = None) -> DataFrame:
    """Pads nested arrays of any depth up to the longest of the table in each dimension, all variables by one aggregate.

    The fill is that of ``fills``, of the variable's metadata or of its type. Null arrays, inner ones too, are filled as empty ones; null variables stay.
    """
    meta, depths = Meta.of(df), {}
    for v in variables:
        kind, depth = df.schema[v].dataType, 0
        while isinstance(kind, T.ArrayType):
            kind, depth = kind.elementType, depth + 1
        depths[v] = (depth, kind)

    def longest(c: Column, level: int) -> Column:
        return F.array_max(F.transform(c, lambda x: longest(x, level - 1))) if level else F.size(c)

    asked = [F.max(longest(F.col(v), k)).alias(f"{v}_{k}") for v, (depth, _) in depths.items() for k in range(depth)]
    found = df.agg(*asked).first() if asked else None
    sizes = {v: [max(found[f"{v}_{k}"] or 0, 0) for k in range(depth)] for v, (depth, _) in depths.items()}

    def padded(c: Column, left: Sequence[int], fill: Column) -> Column:
        if not left:
            return c
        inner = F.transform(F.coalesce(c, F.array()), lambda x: padded(x, left[1:], fill)) if len(left) > 1 else F.coalesce(c, F.array())
        more = F.greatest(F.lit(0), F.lit(left[0]) - F.coalesce(F.size(c), F.lit(0)))
        more = F.when(c.isNull(), F.lit(left[0])).otherwise(more)
        return F.concat(inner, F.array_repeat(_filled(fill, left[1:]), more))

    out = {}
    for v, (_, kind) in depths.items():
        held = (fills or {}).get(v, default_fill(kind) if meta[v, "fill"] is None else meta[v, "fill"])
        out[v] = F.when(F.col(v).isNotNull(), padded(F.col(v), sizes[v], F.lit(held).cast(kind)).cast(df.schema[v].dataType))
    return df.withColumns(out)
