import datetime as dt
import math
import warnings

import pytest
from pyspark.sql import functions as F

from skyframe.functions import coords
from skyframe.functions import time as times
from skyframe.meta import Meta
from skyframe.operators import align, chunks, files, orbits, rows
from skyframe.plans.instrument import Constellation, Instrument, Registry
from skyframe.sources import synthetic
from skyframe.streaming import windows

D = dt.datetime


def frame(spark, points, schema="epoch timestamp_ntz, v double"):
    return spark.createDataFrame(points, schema)


def test_units_and_frequencies():
    assert coords.unit_factor("deg", "h") == 15.0
    assert coords.unit_factor("m", "km") == 1000.0
    assert coords.unit_factor("cm-3", "m-3") == pytest.approx(1e-6)
    with pytest.raises(ValueError):
        coords.unit_factor("m", "deg")
    with pytest.raises(ValueError):
        coords.unit_factor("m", "parsec")
    assert times.frequency_seconds("2h") == 7200 and times.frequency_seconds("s") == 1
    with pytest.raises(ValueError):
        times.frequency_seconds("2 h 3")


def test_common_axis():
    assert coords.common_axis([(0, 359, 360), (10, 340, 34)])[0] == 10
    axis = coords.common_axis([(0, 359, 360), (10, 340, 34)], overlap=False)
    assert (axis[0], axis[-1], len(axis)) == (0, 359, 360)


def test_wrap_is_one_wrap(spark):
    got = [r[0] for r in spark.createDataFrame([(340.0,), (0.5,), (-190.0,), (800.0,)], "x double").select(coords.wrap_once(F.col("x"), 180, -180)).collect()]
    assert got == [-20.0, 0.5, 170.0, 440.0]


def test_parse_and_epochs(spark):
    df = spark.createDataFrame([("09", "2", "30"), ("2009", "2", "3"), ("99", "12", "31")], "y string, m string, d string")
    assert [r[0] for r in df.select(times.parse_parts("y", "m", "d")).collect()] == [None, D(2009, 2, 3), D(2099, 12, 31)]
    one = spark.range(1)
    assert one.select(times.epoch_decode(F.lit(1500), "ms")).first()[0] == D(1970, 1, 1, 0, 0, 1, 500000)
    assert one.select(times.epoch_decode(F.lit(2440588.5), origin="julian")).first()[0] == D(1970, 1, 2)
    assert one.select(times.frequency_text(F.lit(90.0)), times.frequency_text(F.lit(0.5))).first()[:] == ("90s", "500000000ns")


def test_bounds():
    b = chunks.Bounds.of("2009-01-01", "2009-01-10", "2D", "3D")
    assert b.overlaps and [c[1].day for c in b.chunks()] == [1, 3, 5, 7]
    assert len(chunks.Bounds.of(["2012-02-28"], ["2012-03-01"]).chunks()) == 3
    assert [c[1].month for c in chunks.Bounds.of("2009-01-01", "2009-03-31", "1MS", "1MS").chunks()] == [1, 2, 3]
    with pytest.raises(ValueError):
        chunks.Bounds.of("2009-01-02", "2009-01-01")


def test_orbits_of_the_synthetic_day(spark):
    day = synthetic.satellite(spark, "2009-01-01").withColumn("day", F.col("epoch").cast("date"))
    for found in (orbits.cyclic_orbits(day, "mlt", 24.0, "day"), orbits.cyclic_orbits(day.repartition(7), "mlt", 24.0, "day")):
        r = {x["orbit"]: x for x in found.groupBy("orbit").agg(F.min("epoch").alias("a"), F.max("epoch").alias("b")).collect()}
        assert len(r) == 15
        for k in range(14):
            assert r[k + 1]["a"] == D(2009, 1, 1) + dt.timedelta(minutes=97 * k)
            assert r[k + 1]["b"] == D(2009, 1, 1) + dt.timedelta(minutes=97 * k, seconds=5819)


def test_one_orbit(spark):
    df = spark.createDataFrame([(i,) for i in (1, 1, 2, 3)], "orbit long")
    assert orbits.one_orbit(df, 1).count() == 2 and orbits.one_orbit(df, -1).first()[0] == 3
    with pytest.raises(ValueError):
        orbits.one_orbit(df, 0)


def test_alignment_methods(spark):
    data = frame(spark, [(D(2020, 1, 1, 0), 0.0), (D(2020, 1, 2, 4), 28.0)])
    grid = spark.createDataFrame([(D(2020, 1, 1, 7),), (D(2020, 1, 3),), (D(2019, 12, 31),), (D(2020, 1, 1),)], "epoch timestamp_ntz")
    got = {m: {r["epoch"].isoformat()[5:13]: r["v"] for r in align.align(grid, data, ["v"], m).collect()} for m in (None, "ffill", "bfill", "nearest", "linear")}
    assert got["ffill"] == {"01-01T07": 0.0, "01-03T00": 28.0, "12-31T00": None, "01-01T00": 0.0}
    assert got["bfill"] == {"01-01T07": 28.0, "01-03T00": None, "12-31T00": 0.0, "01-01T00": 0.0}
    assert got["linear"]["01-01T07"] == 7.0 and got["linear"]["12-31T00"] is None
    assert got["nearest"]["12-31T00"] == 0.0 and got["nearest"]["01-03T00"] == 28.0
    assert got[None]["01-01T00"] == 0.0 and got[None]["01-01T07"] is None


def test_templates_and_catalog(spark):
    t = files.Template("obs_{year:04d}_{day:03d}_v{version:02d}.nc")
    assert t.glob == "obs_????_???_v??.nc"
    with pytest.raises(ValueError):
        _ = files.Template("a_{year}.nc").glob
    names = ["obs_2008_366_v01.nc", "obs_2009_366_v01.nc", "obs_2009_001_v01.nc", "obs_2009_001_v02.nc", "bad.nc"]
    parsed = files.parse_names(spark.createDataFrame([(n,) for n in names], "file_name string"), t)
    got = {r["file_name"]: r["file_time"] for r in parsed.collect()}
    assert got["obs_2008_366_v01.nc"] == D(2008, 12, 31) and "bad.nc" not in got
    assert {r["file_name"] for r in files.latest_versions(parsed).collect() if r["file_time"] == D(2009, 1, 1)} == {"obs_2009_001_v02.nc"}
    two = files.parse_names(spark.createDataFrame([("x_59.nc",), ("x_10.nc",)], "file_name string"), files.Template("x_{year:02d}.nc"), two_digit_year_break=50)
    assert sorted(r["file_time"].year for r in two.collect()) == [1959, 2010]
    daily = files.daily(parsed.where("version = 2"), "3 days")
    assert [r["file_name"][-10:] for r in daily.orderBy("file_time").collect()] == ["2009-01-01", "2009-01-02", "2009-01-03"]


def test_listing_and_changes(spark, tmp_path):
    for n in ("a_2009-01-01.txt", "a_2009-01-03.txt"):
        (tmp_path / n).write_text("x")
    (tmp_path / "a_2009-01-02.txt").write_text("")
    found = files.list_files(spark, str(tmp_path), files.Template("a_{year:04d}-{month:02d}-{day:02d}.txt"))
    assert sorted(r["file_name"] for r in found.collect()) == ["a_2009-01-01.txt", "a_2009-01-03.txt"]
    assert [r["day"] for r in files.missing_days(found).collect()] == [dt.date(2009, 1, 2)]
    remote = spark.createDataFrame([(D(2009, 1, 1), "b"), (D(2009, 1, 2), "c")], "file_time timestamp_ntz, file_name string")
    assert files.to_download(remote, found.select("file_time", "file_name")).count() == 2


def test_rows(spark):
    df = spark.createDataFrame([(1, 2.0, "a")], "pre_a int, b double, c string")
    assert rows.without_prefix(df, "pre_").columns == ["a", "b", "c"]
    assert rows.rename(df, {"b": "Bee"}, lowercase=True).schema["bee"].metadata["display_name"] == "Bee"
    with pytest.raises(ValueError):
        rows.rename(df, {"zz": "y"})
    with pytest.raises(KeyError):
        rows.drop(df, "zz")
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert rows.drop(df, ["b", "zz"]).columns == ["pre_a", "c"] and w


def test_meta_travels(spark, tmp_path):
    m = Meta({"B": {"units": "km", "value_max": math.nan}}, {"title": "t"})
    df = m.attach(spark.createDataFrame([(1, 2.0)], "a int, b double"))
    df.write.parquet(str(tmp_path / "x"))
    back = Meta.of(spark.read.parquet(str(tmp_path / "x")))
    assert back["b", "units"] == "km" and back["a", "fill"] == -1 and math.isnan(back["b", "value_max"])
    other = Meta({"b": {"units": "m"}, "c": {"units": "s"}})
    merged = m.copy()
    merged.merge(other)
    assert merged["b", "units"] == "km" and m.concat(other)["B", "units"] == "m" and "c" in merged
    with pytest.raises(KeyError):
        m.concat(other, strict=True)
    with pytest.raises(KeyError):
        m.drop("nothing")
    assert m == m.copy() and m != merged and m["title"] == "t"


def test_instrument_pipeline(spark):
    inst = Instrument("p", "n", lambda s: synthetic.satellite(s, "2009-01-01", 2), pad="5 minutes")
    df = inst.load(spark, "2009-01-01 01:00:00", "2009-01-01 02:00:00")
    assert df.count() == 3600
    assert inst.load(spark, "2009-01-01 01:00:00", "2009-01-01 02:00:00", keep_pad=True).count() == 4200
    with pytest.raises(ValueError):
        inst.load(spark)
    with pytest.raises(ValueError):
        inst.attach(lambda d: None).load(spark, "2009-01-01", "2009-01-02")
    order = inst.attach(lambda d: d.withColumn("x", F.lit(1))).attach(lambda d: d.withColumn("x", F.lit(2)), at=0)
    assert order.load(spark, "2009-01-01", "2009-01-01 00:01:00").first()["x"] == 1
    with pytest.raises(ValueError):
        Instrument("p", "n", lambda s: None, clean_level="spotless")


def test_constellation_and_registry(spark):
    def member(name, step, v):
        return Instrument("t", name, lambda s: s.range(10).select(F.timestamp_add("MINUTE", F.col("id") * step, F.lit(D(2020, 1, 1))).alias("epoch"), (F.col("id") * v).cast("double").alias("v"), F.lit("x").alias("s")))

    c = Constellation((member("a", 10, 1), member("b", 20, 2)))
    out = c.to_frame(spark, step="10 minutes", method="linear").orderBy("epoch").collect()
    assert len(out) == 10 and out[1]["v_t_a"] == 1.0 and out[1]["v_t_b"] == 1.0 and out[9]["s_t_b"] == "x"
    r = Registry()
    r.register(c[0])
    with pytest.raises(ValueError):
        r.register(c[0])
    assert r.get("T", "A") is c[0] and len(r.select(["t"]).members) == 1
    r.remove("t")
    assert r.table(spark).count() == 0


def test_nested_sources(spark):
    im = synthetic.imager(spark, "2009-01-01", samples=3)
    assert im.count() == 3 and len(im.first()["images"]) == 7 and len(im.first()["profiles"]) == 5
    assert synthetic.model_grid(spark, "2009-01-01").count() == 96 * 21 * 72
    few = synthetic.unordered(synthetic.satellite(spark, "2009-01-01", samples=20))
    assert rows.time_problems(few, order=["file_row"]).first()["backwards"] == 1


def test_stream_equals_batch(spark, tmp_path):
    day = synthetic.satellite(spark, "2009-01-01", samples=600)
    day.write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(day.schema).parquet(str(tmp_path / "d"))
    got = windows.run_once(windows.chunk_means(stream, "mlt", width="5 minutes"), "means_test", "complete").orderBy("start").collect()
    assert [r["n"] for r in got] == [300, 300] and got[0]["mean"] == pytest.approx(149.5 * 24 / 5820)
    newest = windows.newest_only(spark.createDataFrame([(D(2020, 1, 1), "a", 1), (D(2020, 1, 1), "b", 2)], "file_time timestamp_ntz, file_name string, version int"))
    assert newest.first()["file_name"] == "b"
