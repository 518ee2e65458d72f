"""Orbits stepped through, archives followed as they grow, nested variables on common axes."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyframe.meta import Meta
from skyframe.operators import axes, files, orbits
from skyframe.operators.chunks import Bounds
from skyframe.plans.instrument import Instrument
from skyframe.plans.orbit_record import OrbitRecord
from skyframe.sources.archive import Archive, FileBounds
from skyframe.streaming.ingest import Follower

T0 = datetime(2024, 1, 1)
T = files.Template("o_{year:04d}{month:02d}{day:02d}_v{version:02d}.dat")
SCHEMA = "epoch timestamp_ntz, lat double, n long"


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    """Four days of a row in ten minutes; the latitude changes its sign every 47 rows, so orbits lie over midnight."""
    at = str(tmp_path_factory.mktemp("orbits"))
    rows = [(T0 + timedelta(minutes=10 * i), 1.0 if (i // 47) % 2 else -1.0, i) for i in range(576)]
    archive = Archive((at,), T, schema=SCHEMA)
    archive.write(spark.createDataFrame(rows, SCHEMA), version=1)
    return archive.refresh(spark)


def rule(df):
    return orbits.continuous_polar_orbits(df, "lat", ties=("n",))


def test_orbits_are_loaded_one_by_one(spark, catalog):
    inst = Instrument("t", "o", catalog=catalog)
    player = OrbitRecord.build(spark, inst, rule, ties=("n",)).cursor()
    assert len(player) == 13 and player.current is None
    fourth = player.next().next().next().next()
    assert fourth.current == 3 and sorted(r["n"] for r in fourth.load(spark).collect()) == list(range(141, 188))
    assert sorted(f.rsplit("/", 1)[1] for f in fourth.load(spark).inputFiles() if f.endswith(".dat")) == ["o_20240101_v01.dat", "o_20240102_v01.dat"]
    assert [r["n"] for r in player[-1].load(spark, columns=["n"]).orderBy("n").collect()] == list(range(564, 576))
    assert player.prev().current == 12 and [x.current for x in player][:2] == [0, 1]
    for end in (player[12].next, player[0].prev):
        with pytest.raises(StopIteration):
            end()
    for wrong in (13, -14):
        with pytest.raises(IndexError):
            player[wrong]
    with pytest.raises(ValueError):
        player.load(spark)
    part = OrbitRecord.build(spark, inst, rule, bounds=FileBounds.of("o_20240102_v01.dat", "o_20240103_v01.dat"), ties=("n",)).cursor()
    assert len(part) == 7
    for overlapping in (Bounds.of("2024-01-01", "2024-01-03", "1D", "2D"), FileBounds.of(None, None, step=1, width=2)):
        with pytest.raises(ValueError):
            OrbitRecord.build(spark, inst, rule, bounds=overlapping)


def test_orbits_of_keys_and_ties(spark):
    rows = [(k, T0 + timedelta(hours=h // 2), 1.0 if (h // 3) % 2 else -1.0, h) for k in ("a", None) for h in range(12)]
    inst = Instrument("t", "k", lambda s: s.createDataFrame(rows, "sat string, epoch timestamp_ntz, lat double, n long"))
    record = OrbitRecord.build(spark, inst, lambda df: orbits.continuous_polar_orbits(df, "lat", "sat", period=1e9, ties=("n",)), "sat", ties=("n",))
    for k in ("a", None):
        second = record.cursor(sat=k)[1]
        assert sorted((r["sat"], r["n"]) for r in second.load(spark).collect()) == [(k, 3), (k, 4), (k, 5)]
    assert len(record.cursor(sat="z")) == 0
    with pytest.raises(ValueError):
        record.cursor()


def test_an_archive_that_grows(spark, tmp_path):
    archive = Archive((str(tmp_path / "in"),), T, schema=SCHEMA)
    follower = Follower(archive, str(tmp_path / "table"))
    follower.run(spark)
    assert follower.rows(spark).collect() == [] and follower.catalog(spark).collect() == []
    day = lambda d, values: spark.createDataFrame([(T0 + timedelta(days=d, hours=h), float(v), h) for h, v in enumerate(values)], SCHEMA)
    archive.write(day(0, [1, 2]).unionByName(day(1, [3])), version=1)
    follower.run(spark)
    follower.run(spark)
    held = lambda: sorted((r["file_name"], r["lat"]) for r in follower.rows(spark).collect())
    assert held() == [("o_20240101_v01.dat", 1.0), ("o_20240101_v01.dat", 2.0), ("o_20240102_v01.dat", 3.0)]
    archive.write(day(0, [9]), version=3)
    archive.write(day(1, [8, 8]), version=0)
    archive.write(day(2, [7]), version=1)
    (tmp_path / "in" / "o_stray.dat").write_text("")
    follower.run(spark)
    want = [("o_20240101_v03.dat", 9.0), ("o_20240102_v01.dat", 3.0), ("o_20240103_v01.dat", 7.0)]
    assert held() == want
    assert {(r["file_name"], r["version"]) for r in follower.catalog(spark).collect()} == {("o_20240101_v03.dat", 3), ("o_20240102_v01.dat", 1), ("o_20240103_v01.dat", 1)}
    # a batch that is run again leaves the same table
    again = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in" / "o_20240101_v03.dat")).select("*", F.lit("o_20240101_v03.dat").alias("file_name"))
    follower._take(again, 1)
    assert held() == want
    archive.write(day(0, [1]), version=2)
    follower.run(spark)
    assert held() == want


def test_regridding(spark):
    a, v = [0.0, 1.0, 3.0], [10, 20, 40]
    df = spark.createDataFrame([(1, a, v, ["x", "y", "z"]), (2, a, None, None), (3, None, v, None)], "k long, a array<double>, v array<int>, s array<string>")
    targets = {"a": [-1.0, 0.0, 0.5, 2.0, 3.0, 4.0]}
    moved = lambda method, **o: axes.regrid(df, {"v": ["a"], "s": ["a"]}, targets, method, **o).orderBy("k").collect()
    assert moved("linear")[0]["v"] == [None, 10.0, 15.0, 30.0, 40.0, None] and moved("linear")[0]["s"] == ["x", "x", "x", "y", "z", "z"]
    assert moved(None)[0]["v"] == [-1, 10, -1, -1, 40, -1] and moved(None, fills={"v": 0})[0]["v"] == [0, 10, 0, 0, 40, 0]
    assert moved(None)[0]["s"] == ["", "x", "", "", "z", ""]
    assert moved("ffill")[0]["v"] == [-1, 10, 10, 20, 40, 40] and moved("bfill")[0]["v"] == [10, 10, 20, 40, 40, -1]
    assert moved("nearest")[0]["v"] == [10, 10, 10, 20, 40, 40]
    rows = moved("linear")
    assert rows[0]["a"] == targets["a"] and rows[1]["v"] is None and rows[1]["a"] == targets["a"] and rows[2]["v"] is None and rows[2]["a"] is None
    held = axes.regrid(Meta({"v": {"fill": -99}}).attach(df), {"v": ["a"]}, targets).orderBy("k").first()
    assert held["v"] == [-99, 10, -99, -99, 40, -99]
    for wrong in (({"k": ["a"]}, None), ({"v": ["a", "a"]}, None), ({"v": ["b"]}, None), ({"v": ["a"]}, "cubic")):
        with pytest.raises(ValueError):
            axes.regrid(df, wrong[0], targets, wrong[1])


def test_regridding_two_dimensions_on_shared_axes(spark):
    one = spark.createDataFrame([([0.0, 1.0, 2.0], [0.0, 1.0], [[10.0, 20.0], [20.0, 30.0], [40.0, 0.0]])], "a array<double>, b array<double>, v array<array<double>>")
    other = spark.createDataFrame([([0.5, 2.5], [0.0, 2.0])], "a array<double>, b array<double>")
    assert axes.shared_axes([one, other], ["a", "b"]) == {"a": [0.5, 2.0], "b": [0.0, 1.0]}
    assert axes.shared_axes([one, other], ["a"], overlap=False) == {"a": [0.0, 1.25, 2.5]}
    assert axes.shared_axes([one.where("false")], ["a"]) == {"a": []}
    got = axes.regrid(one, {"v": ("a", "b")}, {"a": [0.5, 2.0, 9.0], "b": [0.0, 0.5]}, "linear").first()
    assert got["v"] == [[15.0, 20.0], [40.0, 20.0], [None, None]]
    assert axes.regrid(one, {"v": ("a", "b")}, {"a": [1.0, 9.0], "b": [1.0, 5.0]}, fills={"v": 0.0}).first()["v"] == [[30.0, 0.0], [0.0, 0.0]]


def test_equal_sizes_of_any_depth(spark):
    df = spark.createDataFrame([([1], [[1.0], None]), ([1, 2], [[1.0, 2.0]]), (None, [])], "n array<int>, v array<array<double>>")
    rows = axes.equal_sizes(Meta({"v": {"fill": 0.0}}).attach(df), ["n", "v"]).collect()
    assert [r["n"] for r in rows] == [[1, -1], [1, 2], None]
    assert [r["v"] for r in rows] == [[[1.0, 0.0], [0.0, 0.0]], [[1.0, 2.0], [0.0, 0.0]], [[0.0, 0.0], [0.0, 0.0]]]
    assert axes.equal_sizes(df.where("false"), ["n", "v"]).collect() == []
