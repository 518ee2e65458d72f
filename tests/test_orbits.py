"""Cyclic orbits over a whole record against a plain loop, whatever the size of blocks."""

import math
import random
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from skyframe.operators import orbits

T0 = datetime(2024, 1, 1, 20)


def scan(rows, span, period):
    """Orbit of each (time, value) of one key in order of time; None is a missing value."""
    n = len(rows)
    step = lambda i: None if i == 0 or rows[i][1] is None or rows[i - 1][1] is None else rows[i][1] - rows[i - 1][1]
    wait = lambda i: None if i == 0 else (rows[i][0] - rows[i - 1][0]).total_seconds()
    typical, last, days = [], None, {}
    for i in range(1, n):
        if rows[i][0].date() == rows[i - 1][0].date() and step(i) is not None:
            days.setdefault(rows[i][0].date(), []).append(step(i))
    for t, _ in rows:
        last = median(days[t.date()]) if t.date() in days else last
        typical.append(last)
    fall = [step(i) is not None and typical[i] is not None and step(i) < -0.2 * typical[i] for i in range(n)]
    big = [step(i) is not None and typical[i] is not None and step(i) > 10 * typical[i] for i in range(n)]
    fits = [big[i] and wait(i) * span < step(i) * period for i in range(n)]
    breaks = []
    for i in range(1, n):
        near = range(max(0, i - 5), min(n, i + 6))
        sure = fall[i] and i + 1 < n and not fall[i + 1] and (i < 5 or not any(big[j] for j in near) or any(big[j] and not fits[j] for j in near))
        norm = wait(i) / period
        gap = norm > 1 or (step(i) is not None and norm > abs(step(i)) / span and norm > 0.95)
        if sure or gap:
            breaks.append(i)
    starts = set()
    for k, i in enumerate(breaks):
        if k == 0:
            starts.add(i)
            continue
        j = breaks[k - 1]
        if rows[i][1] is not None and rows[j][1] is not None and (rows[i][0] - rows[j][0]).total_seconds() / period - (rows[i][1] - rows[j][1]) / span > 0.97:
            starts.add(i)
    out, orbit = [], 1
    for i in range(n):
        orbit += i in starts
        out.append(orbit)
    return out


def record(seed, n):
    """Local time with noise, missing values, gaps, jumps and days without steps, over several midnights."""
    rng = random.Random(seed)
    rows, t = [], T0
    for _ in range(n):
        t += timedelta(seconds=60 if rng.random() < 0.97 else rng.choice([1, 600, 5900, 7000, 90_000]))
        v = ((t - T0).total_seconds() / 5820 * 24) % 24 + rng.uniform(-0.3, 0.3) + (rng.uniform(-9, 9) if rng.random() < 0.03 else 0)
        rows.append((t, None if rng.random() < 0.02 else v))
    return rows


@pytest.mark.parametrize("block", [6, 17, 100_000])
def test_blocks_give_what_one_scan_gives(spark, block):
    rows = [(k, t, math.nan if v is None else v) for k, seed in (("a", 1), ("b", 2), (None, 3)) for t, v in record(seed, 700)] + [("c", T0, 1.0)]
    df = spark.createDataFrame(rows, "sat string, epoch timestamp_ntz, slt double").repartition(5)
    got = {(r["sat"], r["epoch"]): r["orbit"] for r in orbits.continuous_cyclic_orbits(df, "slt", 24.0, "sat", rows_per_block=block).collect()}
    for k, seed in (("a", 1), ("b", 2), (None, 3)):
        mine = record(seed, 700)
        want = scan(mine, 24.0, orbits.DEFAULT_PERIOD_S)
        assert max(want) > 10
        assert [got[k, t] for t, _ in mine] == want
    assert got["c", T0] == 1 and len(got) == 2101


def test_orbits_go_on_over_midnight(spark):
    t = [T0 + timedelta(minutes=m) for m in range(0, 600)]
    rows = [(x, ((x - T0).total_seconds() / orbits.DEFAULT_PERIOD_S * 24) % 24) for x in t]
    df = spark.createDataFrame(rows, "epoch timestamp_ntz, slt double")
    found = orbits.continuous_cyclic_orbits(df, "slt", 24.0, rows_per_block=50)
    spans = found.groupBy("orbit").agg(F.min("epoch").alias("a"), F.max("epoch").alias("b"), F.count("*").alias("n")).orderBy("orbit").collect()
    assert [r["n"] for r in spans[:-1]] == [97] * 6
    assert [(r["a"].day, r["b"].day) for r in spans if r["a"].day != r["b"].day] == [(1, 2)]


def test_odd_records(spark):
    df = spark.createDataFrame([(None, 1.0), (T0, None), (T0, None)], "epoch timestamp_ntz, slt double")
    assert [r["orbit"] for r in orbits.continuous_cyclic_orbits(df, "slt", 24.0, ties=("slt",)).collect()] == [1, 1, 1]
    assert orbits.continuous_cyclic_orbits(df.where("false"), "slt", 24.0).collect() == []
