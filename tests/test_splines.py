"""Splines in blocks against one solve of the whole record; orders, missing values, short records."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from skyframe.operators import align, splines

T0 = datetime(2024, 1, 1, 22)


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_points_polynomials_and_smoothness(order):
    rng = np.random.default_rng(order)
    x = np.cumsum(rng.exponential(1, 60) + 0.05)
    assert np.allclose(splines.spline(x, np.sin(x), x, order), np.sin(x))
    at = np.linspace(x[0], x[-1], 333)
    power = lambda z: 2 * z**order - z + 1
    assert np.allclose(splines.spline(x, power(x), at, order), power(at))
    # order - 1 derivatives go on over every knot
    for knot in splines._knots((x - x[0]) / (x[-1] - x[0]), order)[order + 1 : -order - 1][::9]:
        z, h = knot * (x[-1] - x[0]) + x[0], 1e-3
        sides = [splines.spline(x, np.sin(x), z + s * h * np.arange(1, order + 2), order) for s in (-1, 1)]
        meet = [np.polyval(np.polyfit(s * h * np.arange(1, order + 2), v, order), 0) for s, v in zip((-1, 1), sides)]
        assert abs(meet[0] - meet[1]) < 1e-9


def record(seed, n):
    rng = np.random.default_rng(seed)
    t = [T0 + timedelta(seconds=int(s)) for s in np.cumsum(rng.integers(1, 900, n))]
    return t, rng.normal(size=n)


@pytest.mark.parametrize(("method", "order"), [("quadratic", 2), ("cubic", 3), ("polynomial", 4)])
def test_blocks_give_what_one_solve_gives(spark, monkeypatch, method, order):
    monkeypatch.setattr(splines, "BLOCK_ROWS", 150)
    monkeypatch.setattr(splines, "PART_ROWS", 40)
    rows, grid, want = [], [], {}
    for key, seed in (("a", 1), (None, 2)):
        t, y = record(seed, 700)
        keep = np.random.default_rng(9).random(700) < 0.9
        rows += [(key, a, float(b) if k else float("nan"), float(i)) for i, (a, b, k) in enumerate(zip(t, y, keep))]
        grid += [(key, t[0] + timedelta(minutes=7 * k) - timedelta(hours=1)) for k in range(900)]
        x = np.array([(a - T0).total_seconds() for a in t])
        at = np.array([(g - T0).total_seconds() for k, g in grid if k == key])
        inside = (at >= x[keep][0]) & (at <= x[keep][-1])
        got = splines.spline(x[keep], y[keep], at[inside], order)
        want |= {(key, g): v for (g, v) in zip([g for (k, g), i in zip([q for q in grid if q[0] == key], inside) if i], got)}
    df = spark.createDataFrame(rows, "sat string, epoch timestamp_ntz, y double, n double").repartition(6)
    found = align.align(spark.createDataFrame(grid, "sat string, epoch timestamp_ntz"), df, ["y", "n"], method, "sat", order=order).collect()
    assert len(found) == len(grid) == 1800
    for r in found:
        at = (r["sat"], r["epoch"])
        assert (r["y"] is None) == (at not in want)
        assert at not in want or abs(r["y"] - want[at]) < 1e-7 * max(1, abs(want[at]))
        assert r["y"] is None or r["n"] is not None


def test_short_records_and_ties(spark):
    data = spark.createDataFrame([("a", T0, 1.0), ("a", T0, 3.0), ("a", T0 + timedelta(hours=1), 5.0), ("b", T0, 1.0), (None, None, 7.0)], "k string, epoch timestamp_ntz, y double")
    grid = spark.createDataFrame([(k, T0 + timedelta(minutes=30 * m)) for k in ("a", "b", "c") for m in (-1, 0, 1, 2, 3)], "k string, epoch timestamp_ntz")
    value = lambda method, **o: {(r["k"], (r["epoch"] - T0).seconds // 1800 if r["epoch"] >= T0 else -1): r["y"] for r in align.align(grid, data, ["y"], method, "k", **o).collect()}
    assert {k: v for k, v in value("polynomial", order=1).items() if v is not None} == {("a", 0): 3.0, ("a", 1): 4.0, ("a", 2): 5.0}
    assert all(v is None for v in value("cubic").values())
    assert {k: v for k, v in value("zero").items() if v is not None} == {("a", 0): 3.0, ("a", 1): 3.0, ("a", 2): 5.0, ("b", 0): 1.0}
    assert value("slinear") == value("linear")
    for wrong in ({"method": "polynomial"}, {"method": "polynomial", "order": 9}, {"method": "cubic", "limit": "1 hour"}):
        with pytest.raises(ValueError):
            value(**wrong)
    assert align.align(grid.where("false"), data, ["y"], "cubic", "k").collect() == []
