"""How work grows with the input: frames of windows, keys of state, expressions found once; results against plain loops."""

import bisect
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyframe.functions.arrays import to_long
from skyframe.operators import align, axes, chunks
from skyframe.operators import orbits as batch
from skyframe.streaming import chunks as stream_chunks
from skyframe.streaming import orbits, windows
from tests.test_orbits import record, scan

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("method", ["ffill", "bfill", "nearest", "linear"])
def test_neighbours_ahead_are_found_by_frames_that_grow_from_the_start(spark, method):
    rng = random.Random(3)
    at = {k: sorted(rng.sample(range(400_000), 300)) for k in "ab"}  # seconds over four days; the third has no rows
    at = {k: [t for t in ts if t // 86_400 != 2] for k, ts in at.items()}
    rows = [(k, T0 + timedelta(seconds=t), float(t % 97)) for k, ts in at.items() for t in ts]
    data = spark.createDataFrame(rows, "k string, epoch timestamp_ntz, v double")
    grid = spark.createDataFrame([(k, T0 + timedelta(seconds=t)) for k in "ab" for t in [*range(0, 400_000, 1800), *at[k][::50]]], "k string, epoch timestamp_ntz")
    found = align.align(grid, data, ["v"], method, "k")
    # a frame that ends at a partition's end is summed up anew for every row
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()

    def plain(k, t):
        ts = at[k]
        i, j = bisect.bisect_right(ts, t) - 1, bisect.bisect_left(ts, t)
        p, n = (ts[i] if i >= 0 else None), (ts[j] if j < len(ts) else None)
        if method == "linear":
            if p is None or n is None:
                return None
            return float(p % 97) if p == n else p % 97 + (n % 97 - p % 97) * (t - p) / (n - p)
        if method == "nearest":
            s = p if n is None or (p is not None and t - p <= n - t) else n
        else:
            s = p if method == "ffill" else n
        return None if s is None else float(s % 97)

    for r in found.withColumn("t", F.timestamp_diff("SECOND", F.lit(T0).cast("timestamp_ntz"), "epoch")).collect():
        assert r["v"] == (None if (want := plain(r["k"], r["t"])) is None else pytest.approx(want)), (r, want)


def test_regridding_searches_an_axis_once_for_each_target(spark):
    rows = [(1, [1.0, 2.0, 4.0], [0.0, 1.0], [[1.0, 2.0], [3.0, 4.0], [5.0, 8.0]]), (2, [3.0], [0.5], [[7.0]]), (3, [], [0.0], [])]
    df = spark.createDataFrame(rows, "k int, h array<double>, b array<double>, v array<array<double>>")
    long = to_long(axes.regrid(df, {"v": ("h", "b")}, {"h": [2.0, 3.0], "b": [0.5]}, "linear"), "v", ["i", "j"], "k")
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position") == 2 and plan.count("filter(") == 2
    assert {tuple(r) for r in long.collect()} == {(1, 0, 0, 3.5), (1, 1, 0, 5.0), (2, 0, 0, None), (2, 1, 0, 7.0), (3, 0, 0, None), (3, 1, 0, None)}


def test_long_rows_of_null_and_empty_arrays(spark):
    df = spark.createDataFrame([(1, [[1.0, None], None, []]), (2, None), (3, [])], "k int, v array<array<double>>")
    assert {tuple(r) for r in to_long(df, "v", ["i", "j"], "k").collect()} == {(1, 0, 0, 1.0), (1, 0, 1, None)}


def test_chunks_of_a_stream_keep_one_state_for_many_keys(spark, tmp_path):
    rows = [(f"k{k}", T0 + timedelta(hours=6 * i, minutes=k), float(100 * k + i)) for k in range(40) for i in range(12)]
    end = [[("z", T0 + timedelta(days=60 + i), 0.0)] for i in range(2)]
    for part in (rows[::2], rows[1::2], *end):
        spark.createDataFrame(part, "sat string, epoch timestamp_ntz, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("sat string, epoch timestamp_ntz, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    bounds = chunks.Bounds.of("2024-01-01", "2024-01-02")

    def one(chunk):
        return chunk.assign(prior=chunk["v"].shift(), keys=1)[["v", "prior", "keys"]]

    def many(chunk):
        return chunk.assign(prior=chunk.groupby("sat")["v"].shift(), keys=chunk["sat"].nunique())[["sat", "v", "prior", "keys"]]

    def run(function, together):
        found = stream_chunks.per_chunk(stream, bounds, function, "v double, prior double, keys long", "sat", late="20 days", together=together, buckets=4)
        return windows.run_once(found, f"t_{together}", stateful=True).collect()

    want = {(f"k{k}", i // 4, 100.0 * k + i, 100.0 * k + i - 1 if i % 4 else None) for k in range(40) for i in range(8)}
    single, shared = run(one, False), run(many, True)
    for got in (single, shared):
        assert len(got) == len(want) and {tuple(None if x != x else x for x in (r["sat"], r["chunk_id"], r["v"], r["prior"])) for r in got} == want
    assert min(r["keys"] for r in shared) > 1


def test_orbits_of_many_keys_share_one_state(spark, tmp_path):
    rows = [(f"k{k}", t + timedelta(days=3 * k), v, i) for k in range(12) for i, (t, v) in enumerate(record(k, 60))]
    rows.sort(key=lambda r: r[1])
    last = max(r[1] for r in rows)
    schema = "sat string, epoch timestamp_ntz, slt double, n long"
    for part in (rows[:360], rows[360:], *[[("z", last + timedelta(days=200 + i), 0.0, 0)] for i in range(2)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    found = orbits.cyclic_orbits(stream, "slt", 24.0, "sat", ties=("n",), late="40 days", close_after="100 days", buckets=1)
    got = {(r["sat"], r["n"]): r["orbit"] for r in windows.run_once(found, "t_orbits", stateful=True).where("sat <> 'z'").collect()}
    assert len(got) == 12 * 60
    for k in range(12):
        assert [got[f"k{k}", i] for i in range(60)] == scan(record(k, 60), 24.0, batch.DEFAULT_PERIOD_S)
