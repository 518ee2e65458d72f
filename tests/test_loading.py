"""Selectors, cursors, constellations with little to align, limits and streams from a start."""

import pytest
from pyspark.sql import functions as F

from skyframe.functions import coords
from skyframe.operators import align, chunks, files, orbits
from skyframe.plans.instrument import Constellation, Cursor, Instrument


def rows(spark, times, value=1.0):
    return spark.createDataFrame([(t, value) for t in times], "epoch string, value double").select(F.col("epoch").cast("timestamp_ntz").alias("epoch"), "value")


def instrument(name, times):
    return Instrument("t", name, lambda spark: rows(spark, times))


def test_days_of_the_year(spark):
    inst = instrument("a", ["2023-12-31 23:59:59", "2024-01-01", "2024-01-02 12:00:00", "2024-12-31 01:00:00"])
    assert inst.load(spark, yr=2024, doy=1).count() == 1
    assert inst.load(spark, yr=2024, doy=366).count() == 1
    assert inst.load(spark, yr=2023, doy=365, end_yr=2024, end_doy=3).count() == 3
    for wrong in ({"yr": 2023, "doy": 366}, {"yr": 2024}, {"yr": 2024, "doy": 2, "end_yr": 2024}, {"end_yr": 2024, "end_doy": 2}, {"yr": 2024, "doy": 2, "end_yr": 2024, "end_doy": 2}):
        with pytest.raises(ValueError):
            inst.load(spark, **wrong)
    with pytest.raises(ValueError):
        inst.load(spark, "2024-01-01", "2024-01-02", yr=2024, doy=1)


def test_cursor_moves_within_bounds(spark):
    cursor = Cursor(instrument("a", ["2024-01-01", "2024-01-02", "2024-01-03"]), chunks.Bounds.of("2024-01-01", "2024-01-02"))
    assert cursor.next().load(spark).count() == 1 and cursor.prev().at == 1 and cursor.next().next().prev().at == 0
    for end in (cursor.next().prev, cursor.next().next().next):
        with pytest.raises(StopIteration):
            end()
    with pytest.raises(ValueError):
        cursor.load(spark)


def test_constellations_with_little_to_align(spark):
    a, b = instrument("a", ["2024-01-01", "2024-01-01 02:00:00"]), instrument("b", ["2024-01-05", "2024-01-05 01:00:00"])
    empty = instrument("c", [])
    assert Constellation((a, b)).to_frame(spark, step="1 hour").count() == 0
    assert Constellation((a, b)).to_frame(spark, step="1 hour", overlap=False).count() == 98
    assert Constellation((empty,)).to_frame(spark, step="1 hour").count() == 0
    got = Constellation((a, empty)).to_frame(spark, step="1 hour", method="ffill").orderBy("epoch").collect()
    assert [(r["value_t_a"], r["value_t_c"]) for r in got] == [(1.0, None)] * 3
    # the finest step of any member: half an hour
    fine = instrument("d", ["2024-01-01", "2024-01-01 00:30:00", "2024-01-01 02:00:00"])
    assert Constellation((a, fine)).to_frame(spark, method="ffill").count() == 5


def test_limits_of_alignment(spark):
    grid = rows(spark, ["2024-01-01 00:10:00", "2024-01-01 00:40:00", "2024-01-01 01:05:00"]).select("epoch")
    data = rows(spark, ["2024-01-01", "2024-01-01 01:00:00"])
    for method, want in (("ffill", [1.0, None, 1.0]), ("bfill", [None, None, None]), ("nearest", [1.0, None, 1.0]), ("linear", [None, None, None])):
        got = align.align(grid, data, ["value"], method, limit="15 minutes").orderBy("epoch").collect()
        assert [r["value"] for r in got] == want, method


def test_an_orbit_goes_on_over_midnight(spark):
    times = ["2024-01-01 23:30:00", "2024-01-01 23:50:00", "2024-01-02 00:10:00", "2024-01-02 00:30:00", "2024-01-04 00:00:00"]
    df = rows(spark, times).withColumn("lat", F.when(F.minute("epoch") == 30, -5.0).otherwise(5.0))
    got = orbits.continuous_polar_orbits(df, "lat").orderBy("epoch").collect()
    assert [r["orbit"] for r in got] == [1, 2, 2, 3, 4] and got[0].asDict().keys() == {"epoch", "value", "lat", "orbit"}


def test_files_without_versions_stay(spark):
    f = spark.createDataFrame([("a", 1), ("b", 1)], "file_name string, file_time int")
    assert files.latest_versions(f).count() == 2
    assert files.position(f, "b").first()["position"] == 1


def test_densities():
    assert coords.unit_factor("m-3", "cm-3") == pytest.approx(1e6) and coords.unit_factor("km-3", "m-3") == pytest.approx(1e9)


CATALOG = "file_name string, file_time timestamp_ntz"


def catalog(spark, *days):
    return spark.createDataFrame([(f"f_{d}", None) for d in days], CATALOG).withColumn("file_time", F.substring("file_name", 3, 10).cast("timestamp_ntz"))


def test_files_between_names(spark):
    held = catalog(spark, "2024-01-03", "2024-01-01", "2024-01-02", "2024-01-04")
    spans = [("f_2024-01-01", "f_2024-01-02"), ("f_2024-01-02", "f_2024-01-04"), ("f_2024-01-04", "f_2024-01-01"), ("f_2024-01-01", "none")]
    found = sorted((r["span"], r["file_name"][-2:]) for r in files.between_names(held, spans).collect())
    assert found == [(0, "01"), (0, "02"), (1, "02"), (1, "03"), (1, "04")]
    assert files.between_names(held.limit(0), spans).isEmpty()


def test_snapshots(spark, tmp_path):
    at = str(tmp_path / "catalog")
    with pytest.raises(LookupError):
        files.load_snapshot(spark, at)
    assert files.store_snapshot(catalog(spark, "2024-01-01"), at) == 1
    assert files.store_snapshot(catalog(spark, "2024-01-01", "2024-01-02"), at) == 2
    latest, before = files.load_snapshot(spark, at), files.load_snapshot(spark, at, 1)
    assert latest.columns == ["file_name", "file_time"]
    assert [r["file_name"] for r in files.new_files(latest, before).collect()] == ["f_2024-01-02"]
    with pytest.raises(LookupError):
        files.load_snapshot(spark, at, 2)


def test_ends_of_an_empty_catalog(spark):
    assert tuple(files.first_and_last(catalog(spark, "2024-01-01").limit(0)).first()) == (None, None, 0)


def test_orbit_cursor(spark):
    at = orbits.OrbitCursor(spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "i int, orbit long"))
    with pytest.raises(ValueError):
        at.rows()
    for step in (at, at.next()):
        with pytest.raises(StopIteration):
            step.prev()
    assert at.current is None and at.next().current == 0
    assert [r["i"] for r in at.next().next().rows().collect()] == [3]
    assert at.next().next().next().rows().isEmpty()
    assert at.next().next().prev().rows().count() == 2
