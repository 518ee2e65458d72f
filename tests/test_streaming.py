"""Streams with state against the batch forms, with late rows; empty sources; what is carried from day to day."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyframe.operators import chunks
from skyframe.operators import orbits as batch
from skyframe.streaming import chunks as stream_chunks
from skyframe.streaming import orbits, windows
from tests.test_orbits import record, scan

SCHEMA = "sat string, epoch timestamp_ntz, slt double, n long"
US = timedelta(microseconds=1)


def source(spark, path, parts):
    """Each part of rows is a file, and so a batch, of the stream."""
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(found, stateful=True, mode="append"):
    return windows.run_once(found, f"t_{uuid.uuid4().hex[:8]}", mode, stateful=stateful)


@pytest.mark.parametrize("days", [1, 3, 100])
def test_days_in_turn_give_what_one_scan_gives(days):
    for seed in range(4):
        rows = record(seed, 500)
        want = scan(rows, 24.0, batch.DEFAULT_PERIOD_S)
        by: dict = {}
        for t, v in rows:
            us = (t - datetime(1970, 1, 1)) // US
            by.setdefault(us // orbits._DAY_US, []).append((us, v))
        carry, got, all_days = dict(orbits._START), [], list(by.values())
        for i in range(0, len(all_days), days):
            carry, out = orbits.advance(carry, all_days[i : i + days], 24.0, batch.DEFAULT_PERIOD_S, False)
            got += out
        assert len(got) == 500 - 5
        carry, out = orbits.advance(carry, [], 24.0, batch.DEFAULT_PERIOD_S, True)
        assert [o for _, o in got + out] == want
        assert len(carry["told"]) == 6 and not carry["waits"]


def test_orbits_of_a_stream_with_late_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, t, v, i) for k, seed in (("a", 1), ("b", 2)) for i, (t, v) in enumerate(record(seed, 300))]
    rows.sort(key=lambda r: r[1] + timedelta(hours=30 if rng.random() < 0.1 else 0))
    end = max(r[1] for r in rows) + timedelta(days=90)
    parts = [rows[i : i + 200] for i in range(0, 600, 200)] + [[("z", end, 0.0, 0)], [("z", end + timedelta(days=1), 0.0, 1)]]
    found = orbits.cyclic_orbits(source(spark, tmp_path / "s", parts), "slt", 24.0, "sat", ties=("n",), late="40 days", close_after="10 days")
    got = {(r["sat"], r["n"]): r["orbit"] for r in run(found).where("sat <> 'z'").collect()}
    for k, seed in (("a", 1), ("b", 2)):
        assert [got[k, i] for i in range(300)] == scan(record(seed, 300), 24.0, batch.DEFAULT_PERIOD_S)
    assert len(got) == 600


def test_chunks_of_a_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("a", t0 + timedelta(hours=12 * i), float(i), i) for i in range(16)]
    parts = [[r for r in rows if r[3] % 5], [r for r in rows if not r[3] % 5], [("a", t0 + timedelta(days=60), 0.0, 99)], [("a", t0 + timedelta(days=61), 0.0, 99)]]

    def first(chunk):
        return chunk.assign(first=chunk["n"].min(), rows=len(chunk))[chunk["in_chunk"]][["n", "first", "rows"]]

    bounds = chunks.Bounds.of("2024-01-02", "2024-01-06", "2D", "3D")
    found = run(stream_chunks.per_chunk(source(spark, tmp_path / "s", parts), bounds, first, "n long, first long, rows long", "sat", pad="13 hours", late="20 days"))
    assert {tuple(r)[1:] for r in found.collect()} == {(k, n, 1 + 4 * k, 9) for k in range(2) for n in range(2 + 4 * k, 8 + 4 * k)}


def test_sources_without_data(spark, tmp_path):
    nothing = source(spark, tmp_path / "s", [[]])
    assert run(orbits.cyclic_orbits(nothing, "slt", 24.0, "sat")).collect() == []
    assert run(windows.chunk_means(nothing, "slt"), False).collect() == []
    (tmp_path / "e").mkdir()
    empty = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "e"))
    for mode in ("append", "complete"):
        done = run(windows.chunk_means(empty, "slt"), False, mode)
        assert done.collect() == [] and done.columns == ["start", "end", "mean", "n"]
    rows = source(spark, tmp_path / "r", [[("a", datetime(2024, 1, 1), 1.0, 1)]])
    assert run(rows.select("sat", F.col("n")), False).columns == ["sat", "n"]
