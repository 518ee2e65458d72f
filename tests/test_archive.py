"""Archives: catalogs, loads that open the chosen files only, iteration by files, pads and steps per chunk, names."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyframe.operators import chunks, files
from skyframe.plans.instrument import Cursor, Instrument
from skyframe.sources.archive import Archive, FileBounds

T = files.Template("sat_{year:04d}{month:02d}{day:02d}_v{version:02d}.dat")
D0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    """Ten days of six rows four hours apart, the third day in a later version too, with a stray file and an empty one."""
    at = tmp_path_factory.mktemp("archive")
    rows = [(i, D0 + timedelta(hours=4 * i), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "n long, epoch timestamp_ntz, value double")
    archive = Archive((str(at / "none"), str(at / "data")), T, schema="n long, epoch timestamp_ntz, value double")
    archive.write(df, folder=str(at / "data"), version=1)
    archive.write(df.where(F.col("epoch").cast("date") == F.lit("2024-01-03").cast("date")).withColumn("value", -F.col("value")), folder=str(at / "data"), version=2)
    (at / "data" / "notes.txt").write_text("x")
    (at / "data" / "sat_20240120_v01.dat").write_text("")
    return archive.refresh(spark)


def day(n, version=1):
    return f"sat_202401{n:02d}_v{version:02d}.dat"


def opened(df):
    return sorted(f.rsplit("/", 1)[1] for f in df.inputFiles() if f.endswith(".dat"))


def test_catalog_lookup(catalog):
    assert len(catalog) == 10
    assert [r["file_name"] for r in catalog.table.orderBy("file_number").collect()] == [day(n, 2 if n == 3 else 1) for n in range(1, 11)]
    assert catalog.number(day(3, 2)) == 2
    names = lambda df: [r["file_name"] for r in df.orderBy("file_number").collect()]
    assert names(catalog[-1]) == [day(10)] and names(catalog["2024-01-02"]) == [day(2)]
    assert names(catalog[1:4]) == [day(2), day(3, 2), day(4)] and names(catalog[::4]) == [day(1), day(5), day(9)]
    assert names(catalog["2024-01-02":"2024-01-04"]) == [day(2), day(3, 2)]
    assert names(catalog[day(2) : day(4)]) == [day(2), day(3, 2), day(4)] and names(catalog[day(9) :]) == [day(9), day(10)]
    for wrong, error in ((10, IndexError), (-11, IndexError), (day(3, 1), ValueError), (slice(None, None, -1), ValueError)):
        with pytest.raises(error):
            catalog[wrong]


def test_loads_open_the_chosen_files_only(spark, catalog):
    inst = Instrument("t", "files", catalog=catalog)
    some = inst.load(spark, fname=day(2), stop_fname=day(4))
    assert opened(some) == [day(2), day(3, 2), day(4)] and some.columns == ["n", "epoch", "value"]
    assert sorted(r["value"] for r in some.collect()) == sorted([*map(float, range(6, 12)), *(-float(x) for x in range(12, 18)), *map(float, range(18, 24))])
    timed = inst.load(spark, "2024-01-05 20:00:00", "2024-01-07")
    assert opened(timed) == [day(5), day(6)] and sorted(r["n"] for r in timed.collect()) == list(range(29, 36))
    assert opened(inst.load(spark, yr=2024, doy=9)) == [day(9)]
    assert inst.load(spark).count() == 60
    assert inst.load(spark, "2025-01-01", "2025-01-02").collect() == []
    for wrong in ({"stop_fname": day(2)}, {"fname": day(4), "stop_fname": day(2)}, {"fname": "x"}, {"fname": day(1), "yr": 2024, "doy": 1}, {"fname": day(1), "start": "2024-01-01"}):
        with pytest.raises(ValueError):
            inst.load(spark, **wrong)
    with pytest.raises(ValueError):
        Instrument("t", "plain", lambda s: s.range(1)).load(spark, fname="a")
    with pytest.raises(ValueError):
        Instrument("t", "nothing")


def test_pads_of_files(spark, catalog):
    prior = lambda df, chunk: df.withColumn("prior", F.lag("n").over(Window.partitionBy(*chunk, F.lit(0)).orderBy("epoch")))
    inst = Instrument("t", "files", catalog=catalog, pad="5 hours").attach(prior)
    got = inst.load(spark, fname=day(5))
    assert opened(got) == [day(4), day(5), day(6)]
    assert [(r["n"], r["prior"]) for r in got.orderBy("n").collect()] == [(n, n - 1) for n in range(24, 30)]
    # chunks of two files, one file apart: each has its own pad
    found = inst.iterate(spark, FileBounds.of(day(2), day(5), width=2))
    assert {(r["chunk_id"], r["n"], r["prior"]) for r in found.collect()} == {(k, n, n - 1) for k in range(3) for n in range(6 + 6 * k, 18 + 6 * k)}
    kept = inst.iterate(spark, FileBounds.of(day(2), day(3, 2), width=2), keep_pad=True)
    assert sorted((r["n"], r["in_chunk"]) for r in kept.collect()) == [(5, False), *((n, True) for n in range(6, 18)), (18, False), (19, False)]


def test_iteration_by_files(spark, catalog):
    inst = Instrument("t", "files", catalog=catalog)
    found = inst.iterate(spark, FileBounds.of((day(1), day(6)), (day(4), None), step=2, width=2))
    assert opened(found) == [day(n, 2 if n == 3 else 1) for n in (1, 2, 3, 4, 6, 7, 8, 9)]
    by = {r["chunk_id"]: (r["a"], r["b"], r["n"]) for r in found.groupBy("chunk_id").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("n")).collect()}
    assert by == {0: (0, 11, 12), 1: (12, 23, 12), 2: (30, 41, 12), 3: (42, 53, 12)}
    cursor = Cursor(inst, FileBounds.of(None, day(5), step=2, width=2))
    assert opened(cursor.next().next().load(spark)) == [day(3, 2), day(4)] and cursor.prev().at == 1
    with pytest.raises(StopIteration):
        cursor.next().next().next()
    assert inst.iterate(spark, FileBounds.of(day(1), day(2), width=3)).collect() == []
    for wrong in (lambda: inst.iterate(spark, FileBounds.of(day(4), day(1))), lambda: FileBounds.of((day(1),), (day(1), day(2))), lambda: FileBounds.of(day(1), day(2), width=0)):
        with pytest.raises(ValueError):
            wrong()


def test_days_that_run_over_into_other_files(spark, tmp_path):
    """A file of a day with rows of its neighbours; loads by time find them where the archive says how far to look."""
    for n, hours in ((1, (0, 12, 25)), (2, (23, 26, 40)), (3, (49, 60, 47))):
        spark.createDataFrame([(D0 + timedelta(hours=h), h) for h in hours], "epoch timestamp_ntz, h long").coalesce(1).write.parquet(str(tmp_path / f"x{n}"))
        next((tmp_path / f"x{n}").glob("part-*")).rename(tmp_path / f"s_2024010{n}_v01.dat")
    archive = Archive((str(tmp_path),), files.Template("s_{year:04d}{month:02d}{day:02d}_v{version:02d}.dat"), schema="epoch timestamp_ntz, h long", slack="2 hours")
    inst = Instrument("t", "over", catalog=archive.refresh(spark))
    assert sorted(r["h"] for r in inst.load(spark, "2024-01-02", "2024-01-03").collect()) == [25, 26, 40, 47]
    assert sorted(r["h"] for r in inst.load(spark, fname="s_20240102_v01.dat").collect()) == [23, 26, 40]


def test_archive_without_files(spark, tmp_path):
    archive = Archive((str(tmp_path / "none"), str(tmp_path)), T, "csv", "n long, epoch timestamp_ntz")
    catalog = archive.refresh(spark, str(tmp_path / "snapshots"))
    inst = Instrument("t", "none", catalog=catalog)
    assert len(catalog) == 0 and inst.load(spark).collect() == [] and inst.load(spark).columns == ["n", "epoch"]
    assert inst.iterate(spark, FileBounds.of()).collect() == []
    archive.write(spark.createDataFrame([(1, D0)], archive.schema), folder=str(tmp_path), version=3)
    again = archive.refresh(spark, str(tmp_path / "snapshots"))
    assert [tuple(r) for r in Instrument("t", "one", catalog=again).load(spark).collect()] == [(1, D0)]
    assert files.new_files(again.table, files.load_snapshot(spark, str(tmp_path / "snapshots"), 1)).count() == 1


def test_steps_see_their_own_chunk_only(spark):
    rows = [(D0 + timedelta(hours=12 * i), i) for i in range(20)]
    inst = Instrument("t", "a", lambda s: s.createDataFrame(rows, "epoch timestamp_ntz, n long"), pad="13 hours")
    inst = inst.attach(lambda df, chunk: df.withColumn("first", F.min("n").over(Window.partitionBy(*chunk, F.lit(0)))))
    found = inst.iterate(spark, chunks.Bounds.of("2024-01-02", "2024-01-06", "2D", "3D")).collect()
    assert {(r["chunk_id"], r["n"], r["first"]) for r in found} == {(k, n, 2 + 4 * k - 1) for k in range(2) for n in range(2 + 4 * k, 8 + 4 * k)}
    assert inst.iterate(spark, chunks.Bounds.of("2024-01-02", "2024-01-02", "1D", "3D")).collect() == []


def test_pandas_steps(spark):
    rows = [(D0 + timedelta(hours=12 * i), i, i % 2) for i in range(20)]
    inst = Instrument("t", "a", lambda s: s.createDataFrame(rows, "epoch timestamp_ntz, n long, k long"), pad="1 day")

    def steps(pdf):
        out = pdf.assign(sum=pdf["n"].rolling(2, min_periods=1).sum())
        return pd.concat([out[out["n"] != 4], pd.DataFrame({"epoch": [pdf["epoch"].max()], "n": [-1], "k": [pdf["k"].iloc[0]], "sum": [0.0]}, index=[999])])

    schema = "epoch timestamp_ntz, n long, k long, sum double"
    by_key = inst.attach_pandas(steps, schema, "k")
    loaded = by_key.load(spark, "2024-01-02", "2024-01-04", keep_pad=True)
    assert sorted((r["n"], r["sum"]) for r in loaded.collect()) == [(-1, 0.0), (-1, 0.0), (0, 0.0), (1, 1.0), (2, 2.0), (3, 4.0), (5, 8.0), (6, 10.0), (7, 12.0)]
    found = by_key.iterate(spark, chunks.Bounds.of("2024-01-02", "2024-01-05", "2D", "2D")).where("n >= 0")
    assert {(r["chunk_id"], r["n"], r["sum"]) for r in found.collect()} == {(0, n, 2.0 * n - 2) for n in (2, 3, 5)} | {(1, n, 2.0 * n - 2) for n in (6, 7, 8, 9)}


def test_names_with_delimiters(spark):
    t = files.Template("*_{year:d}_{day:d}_{inst_id:s}_v{major_no:d}*", delimiter="_")
    names = ["a_2024_7_ivm_v12.nc", "a__2024__007_b-c_v3_late.nc", "2024_7_ivm_v1", "a_b_2024_7_ivm_v1", "a_2024_400_ivm_v1", "a_2024_x_ivm_v1", None]
    got = files.parse_names(spark.createDataFrame([(n,) for n in names], "file_name string"), t).collect()
    assert {(r["file_name"], r["file_time"].day, r["inst_id"], r["major_no"]) for r in got} == {(names[0], 7, "ivm", 12), (names[1], 7, "b-c", 3)}
    assert t.glob == "*_*_*_*_v**"
    back = files.Template("{year:02d}{month:02d}.cdf", from_end=True)
    got = files.parse_names(spark.createDataFrame([("any/99_9_5912.cdf",), ("2001.cdf",), ("1.cdf",)], "file_name string"), back, two_digit_year_break=50).collect()
    assert {r["file_time"] for r in got} == {datetime(1959, 12, 1), datetime(2020, 1, 1)}
    assert files.Template("a_{year:04d}_{day:03d}.h").name("2024-02-01") == "a_2024_032.h"


def test_positions_and_gaps(spark):
    f = spark.createDataFrame([("b", D0), ("b", D0 + timedelta(days=3)), ("a", D0 + timedelta(days=3)), ("c", None)], "file_name string, file_time timestamp_ntz")
    assert sorted(r["position"] for r in files.position(f, "b").collect()) == [1, 3]
    assert files.position(f, "z").collect() == []
    assert [r["day"].day for r in files.missing_days(f).orderBy("day").collect()] == [2, 3]
    assert files.missing_days(f, "file_name").select("file_name", F.dayofmonth("day")).collect() == [("b", 2), ("b", 3)]
