"""Steps of whole records, limits in rows, labels and headers, constellations as wholes, registries of modules, assigned values."""

import math
import types
import warnings
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyframe.functions import coords, values
from skyframe.functions import time as times
from skyframe.meta import EPOCH_TEXT, Meta
from skyframe.operators import align, files, rows
from skyframe.parameters import Parameters
from skyframe.plans import bundled
from skyframe.plans.instrument import Constellation, Instrument, Registry
from skyframe.sources import synthetic

T0 = datetime(2024, 1, 1)


def record(spark, minutes):
    return spark.createDataFrame([(T0 + timedelta(minutes=m), float(m)) for m in minutes], "epoch timestamp_ntz, value double")


def test_least_step_over_midnight(spark):
    assert times.least_step(record(spark, [0, 60, 1430, 1442, 3000]), "epoch").first()[0] == 720.0
    assert times.least_step(record(spark, [0, 10, 2000]), "epoch").first()[0] == 600.0
    assert times.least_step(record(spark, [5]), "epoch").first()[0] is None and times.least_step(record(spark, []), "epoch").first()[0] is None
    assert times.least_step(record(spark, [5, 5]), "epoch").first()[0] == 0.0


def test_cadences_and_today(spark):
    assert [times.at_most_daily(c) for c in ("1D", "D", "90min", "2D", "1MS", "YS", "36h")] == [True, True, True, False, False, False, False]
    r = spark.range(1).select(times.today().alias("a"), times.today(-1).alias("b")).first()
    assert r["a"] - r["b"] == timedelta(days=1) and r["a"].hour == 0


def test_limits_in_rows(spark):
    data, grid = record(spark, [0, 50]), record(spark, [0, 10, 20, 30, 40, 50, 60, 70]).select("epoch")
    value = lambda how, n: [r["value"] for r in align.align(grid, data, ["value"], how, limit_rows=n).orderBy("epoch").collect()]
    assert value("ffill", 1) == [0, 0, None, None, None, 50, 50, None] and value("bfill", 2) == [0, None, None, 50, 50, 50, None, None]
    assert value("ffill", 0) == [0, None, None, None, None, 50, None, None]
    for how in ("nearest", "linear", "cubic"):
        with pytest.raises(ValueError):
            value(how, 1)


def test_labels_and_headers(spark, tmp_path):
    meta = Meta({"value": {"units": "m", "fill": -1.0}}, header={"mission": "x", "orbits": 3})
    held = meta.attach(record(spark, [0]))
    assert Meta.of(held).header == meta.header and Meta.of(held.select(F.col("value").alias("v"))).header == meta.header
    held.write.parquet(str(tmp_path / "p"))
    assert Meta.of(spark.read.parquet(str(tmp_path / "p"))).header == meta.header
    meta.relabel({"units": "unit", "axis": "axis"})
    assert meta["value", "unit"] == "m" and meta["value", "axis"] == "" and "units" not in meta["value"]
    with pytest.raises(ValueError):
        meta.relabel({"unit": "notes"})
    other = Meta({"a": {"UNIT": "s", "source": "b"}})
    meta.accept_labels(other)
    assert meta["value", "UNIT"] == "m" and "unit" not in meta["value"] and meta["value", "source"] == "" and other["a", "axis"] == "" and math.isnan(meta["value", "value_min"])
    meta.to_header({"doi": "d"})
    with pytest.raises(AttributeError):
        meta.to_header({"doi": "e", "new": 1}, strict=True)
    assert meta.header == {"mission": "x", "orbits": 3, "doi": "d"}
    epoch = Meta({"epoch": {"desc": "said"}})
    epoch.add_epoch()
    assert epoch["epoch", "desc"] == "said" and epoch["epoch", "units"] == epoch["epoch", "long_name"] == EPOCH_TEXT
    fresh = Meta()
    fresh.add_epoch("time")
    assert fresh["time", "notes"] == EPOCH_TEXT


def test_constellations_as_wholes(spark):
    labels = Meta({"value": {"units": "m", "fill": -9.0}})
    a = Instrument("Sat", "a", lambda s: record(s, [0, 10, 20]), tag="x", clean_level="clean", pad=None, meta=labels)
    b = Instrument("Sat", "b", lambda s: record(s, [0, 20]).withColumn("more", F.lit(1)), tag="x", clean_level="dirty")
    none = Instrument("Sat", "none", lambda s: record(s, []))
    both = Constellation((a, b))
    assert both.attributes() == {"platform": "Sat", "name": "a_b", "tag": "x", "inst_id": "", "clean_level": "dirty", "pad": None}
    assert both.distinct("platform") == ["Sat"] and Constellation((a, b, none)).distinct("tag") == ["x", ""]
    framed = both.to_frame(spark)
    assert framed.count() == 3 and Meta.of(framed)["value_sat_a_x", "units"] == "m" and Meta.of(framed).header["name"] == "a_b"
    assert [r["value_sat_a_x"] for r in framed.orderBy("epoch").collect()] == [0.0, 10.0, 20.0]
    loaded = both.load(spark)
    assert not both.empty(loaded) and not both.empty_partial(loaded)
    some = Constellation((a, none))
    assert not some.empty(some.load(spark)) and some.empty_partial(some.load(spark))
    assert Constellation((none,)).empty(Constellation((none,)).load(spark)) and Constellation(()).empty({}) and Constellation(()).empty_partial({})
    assert both.drop(loaded, "value")["sat_b_x"].columns == ["epoch", "more"]
    assert both.drop(loaded, ["value_sat_a_x", "more"])["sat_a_x"].columns == ["epoch"] and loaded["sat_a_x"].columns == ["epoch", "value"]
    with pytest.raises(KeyError):
        both.drop(loaded, "nothing")
    double = lambda df: df.withColumn("value", F.col("value") * 2)
    stepped = both.attach(double, members=True).attach(lambda x, k: {n: d.where("value > 0") for n, d in x.items() if n != k}, "sat_b_x")
    assert [r["value"] for r in stepped.load(spark)["sat_a_x"].orderBy("epoch").collect()] == [20.0, 40.0]
    assert sorted(stepped.cleared().load(spark)) == ["sat_a_x", "sat_b_x"]


def test_instruments_of_a_module():
    module = types.ModuleType("m")
    module.other = 3
    module.one, module.two, module._hidden = (Instrument("p", n, lambda s: s.range(1)) for n in "abc")
    registry = Registry()
    assert registry.register_module(module) == 2 and registry.get("p", "b") is module.two
    module.third = Instrument("p", "d", lambda s: s.range(1))
    with pytest.raises(ValueError):
        registry.register_module(module)
    with pytest.raises(KeyError):
        registry.get("p", "d")
    assert registry.register_module(module, overwrite=True) == 3


def test_assigned_values_and_equality(spark):
    df = record(spark, [0, 10])
    assert rows.assign_values(df, "p", [[1, 2], [3, 4]], (2, 2)).first()["p"] == [[1, 2], [3, 4]]
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert math.isnan(rows.assign_values(df, "p", []).first()["p"]) and said
    for wrong, dims in (([1, 2], (3,)), ([[1], [2, 3]], ())):
        with pytest.raises(ValueError):
            rows.assign_values(df, "p", wrong, (dims or (2, 1)))
    assert rows.variables(df) == ["value"]
    assert rows.same(df, record(spark, [10, 0])) and not rows.same(df, record(spark, [0])) and not rows.same(df, df.withColumn("x", F.lit(1)))
    assert not rows.same(record(spark, [0, 0, 1]), record(spark, [0, 1, 1])) and not rows.same(df, Meta({"value": {"units": "m"}}).attach(df))
    assert rows.concat(df, record(spark, [20, 30]), start="2024-01-01 00:10:00", stop="2024-01-01 00:30:00").count() == 2


def test_labelled_fills(spark):
    df = spark.createDataFrame([(1.0, -1, "a"), (-9.0, 2, ""), (math.nan, 3, None)], "x double, n int, s string")
    held = Meta({"x": {"fill": -9.0, "units": "m"}, "n": {"fill": -1}, "s": {"fill": ""}}).attach(df)
    out = coords.replace_labelled_fill(held)
    assert [(None if r["x"] is None else str(r["x"]), r["n"], r["s"]) for r in out.collect()] == [("1.0", None, "a"), ("nan", 2, ""), ("nan", 3, None)]
    assert math.isnan(Meta.of(out)["x", "fill"]) and Meta.of(out)["x", "units"] == "m"
    again = coords.replace_labelled_fill(out, ["x"], 0.0)
    assert [r["x"] for r in again.collect()] == [1.0, 0.0, 0.0] and Meta.of(again)["x", "fill"] == 0.0
    assert coords.replace_labelled_fill(df).collect()[0] == (1.0, -1, "a")


def test_median_steps(spark):
    df = spark.createDataFrame([("a", T0, 1.0), ("a", T0 + timedelta(1), 4.0), ("a", T0 + timedelta(2), 5.0), ("a", T0 + timedelta(3), math.nan), ("b", T0, 1.0)], "k string, epoch timestamp_ntz, v double")
    assert {r["k"]: r["median_step"] for r in times.median_step(df, "v", "k").collect()} == {"a": 2.0, "b": None}


def test_lists_of_files(spark):
    t = files.Template("f_{year:04d}-{month:02d}-{day:02d}_{hour:02d}.nc")
    made = files.made_up(spark, t, "2024-02-28", "2024-03-01", "12 hours", "5 minutes").orderBy("file_time").collect()
    assert [r["file_name"] for r in made] == [f"f_2024-{d}_{h}.nc" for d in ("02-28", "02-29", "03-01") for h in ("00", "12")][:5]
    assert made[0]["file_time"] == datetime(2024, 2, 28, 0, 5)
    f = spark.createDataFrame([("d/a", T0, 2), ("da", T0, 1), ("d/d/b", T0 - timedelta(1), 3), ("x", None, 0)], "file_name string, file_time timestamp_ntz, i int")
    assert sorted(r["file_name"] for r in files.without_folder(f, "d").collect()) == ["a", "d/b", "da", "x"]
    assert not files.unique_times(f) and files.unique_times(f.where("i > 1"))
    assert tuple(files.listed_range(f, "i").first()) == (T0, T0 - timedelta(1))


def test_values(spark):
    assert values.listed(None) == [] and values.listed("ab") == ["ab"] and values.listed([1, (2, [3]), "x"]) == [1, 2, 3, "x"] and values.listed(b"a") == [b"a"]
    df = spark.createDataFrame([(bytearray(b"a\xc3\xa9"), [bytearray(b"x"), None], 1)], "a binary, b array<binary>, n int")
    assert tuple(values.texts(df).first()) == ("aé", ["x", None], 1) and values.texts(df, "b").dtypes[0][1] == "binary"
    assert values.mapped("a", {"a": 1}) == 1 and values.mapped("b", {"a": 1}) is None and values.mapped(2, lambda x: x + 1) == 3
    kinds = spark.sql("SELECT true a, 1 b, 1.5 c, 1.5D d, 'x' e, binary('x') f, now() g, array(array(1)) h, struct(1) i").schema
    assert "".join(values.type_code(f.dataType) for f in kinds) == "biffUSMiO"


def test_processed_labels(spark):
    def shout(meta):
        meta["value", "units"] = meta["value", "units"].upper()
        return meta

    inst = Instrument("t", "a", lambda s: record(s, [0]), meta=Meta({"value": {"units": "m"}}), process_meta=shout)
    assert Meta.of(inst.load(spark))["value", "units"] == "M"
    with pytest.raises(ValueError):
        Instrument("t", "a", lambda s: record(s, [0]), process_meta=lambda m: None).load(spark)


def test_synthetic_records_and_bundled_instruments(spark):
    day = synthetic.satellite(spark, "2009-01-01", samples=10)
    assert [day.schema[f"int{n}_dummy"].dataType.simpleString() for n in (8, 16, 32, 64)] == ["tinyint", "smallint", "int", "bigint"] and day.first()["unicode_dummy"] == "test"
    image = synthetic.imager(spark, "2009-01-01", samples=2).first()
    assert image["image_lon"][3] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0] and image["variable_profile_height"] == [0.0, 1.0, 2.0, 3.0, 4.0]
    high = synthetic.model_heights(spark, "2009-01-01")
    assert high.count() == 96 * 21 * 72 * 41
    r = high.where("latitude = -45 AND longitude = 10 AND altitude = 305 AND epoch = timestamp_ntz'2009-01-01 01:15:00'").first()
    assert r["dummy1"] == (4500 * -45 * 10) % 21 and r["dummy2"] == (r["dummy1"] * 305) % 21 and r["mlt"] == pytest.approx(r["slt"] + 0.2)
    levels = synthetic.model_levels(spark, "2009-01-01")
    r = levels.where("latitude = 88.75 AND longitude = 177.5 AND ilev = 7.125 AND epoch = timestamp_ntz'2009-01-01 06:00:00'").first()
    assert r["altitude"] == pytest.approx((560 + 6 + 1) * 1e5) and r["dummy_drifts"] == pytest.approx(2 * 56 * 2)
    registry = Registry()
    assert registry.register_module(bundled) == 4 and registry.get("skyframe", "nothing") is bundled.nothing
    assert bundled.empty.empty(bundled.empty.load(spark)) and bundled.partial.empty_partial(bundled.partial.load(spark)) and not bundled.single.empty(bundled.single.load(spark))
    assert len(bundled.several.load(spark)) == 3


def test_parameters(tmp_path):
    at = str(tmp_path / "p" / "settings.json")
    p = Parameters(at)
    assert p["data_dirs"] == [] and p["clean_level"] == "clean" and p.folders("a", "b") == ()
    p["data_dirs"] = "/data/"
    p["mine"] = {"x": 1}
    p["update_files"] = False
    p.store()
    again = Parameters(at)
    assert dict(again) == dict(p) and again.folders("sat", "ivm", "t") == ("/data/sat/ivm/t",)
    again.restore_defaults()
    assert again["update_files"] is True and again["data_dirs"] == ["/data/"] and again["mine"] == {"x": 1}
    del again["mine"]
    again.clear()
    assert len(again) == len(list(again)) == 6 and Parameters(at)["mine"] == {"x": 1}
    for wrong, error in ((lambda: again["mine"], KeyError), (lambda: again.__delitem__("clean_level"), KeyError), (lambda: again.__setitem__("clean_level", 3), ValueError), (lambda: again.__setitem__("x", {1}), TypeError), (Parameters().store, ValueError)):
        with pytest.raises(error):
            wrong()
