import bz2
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.sinks import writers
from driftwell.sources import archive, binary, text
from driftwell.sources.config import Config, nearest_names, valid_for


def test_delimited_and_headed(spark, tmp_path):
    (tmp_path / "a.dat").write_text("# t a b\n0.0 1 2\n0.1 3 4\nbroken\n0.2 x 6\n")
    got = text.delimited_samples(spark, str(tmp_path / "a.dat"), channels=["a", "b"]).orderBy("timebase", "channel").select("timebase", "channel", "signal").collect()
    assert [tuple(r) for r in got] == [(0.0, "a", 1.0), (0.0, "b", 2.0), (0.1, "a", 3.0), (0.1, "b", 4.0), (0.2, "a", None), (0.2, "b", 6.0)]
    (tmp_path / "b.dat").write_text("# Name = 'wp'\n# DimName = 'Time'\n# ValName = 'Wp', 'Wb'\n# [data]\n0.1, 2.0, 3.0\n0.2, 4.0, 5.0\n")
    head, rows = text.headed_ascii(spark, str(tmp_path / "b.dat"))
    assert head["name"] == "wp" and rows.columns == ["Time", "Wp", "Wb"] and rows.count() == 2


def test_fluctuation_lines_round_trip(spark):
    df = spark.createDataFrame([(5, 0.5, 3, 24.1, 0.01, 0.9, 0.6, 0.2, [0.1, -0.2])], "shot long, t_mid double, svs long, freq double, amp double, a12 double, p double, h double, phases array<double>")
    lines = text.fluctuation_lines(df).unionByName(spark.createDataFrame([("Shot time SVS",), ("# note",), ("5 0.5 oops",)], "value string"))
    good, bad = text.parse_fluctuation_lines(lines, phases=2)
    assert [tuple(r) for r in good.collect()] == [tuple(r) for r in df.collect()] and bad.count() == 1
    f = spark.createDataFrame([("f", i, s, t) for i, (s, t) in enumerate([(1, 0.1), (1, 0.2), (1, 0.15), (2, 0.1)])], "file string, i int, shot int, t_mid double")
    assert [r["fault"] for r in text.line_faults(f, ["file"], "i").orderBy("i").collect()] == [0, 0, 4, 2]


def test_logs_links_parameters_and_times(spark):
    one = lambda s: spark.createDataFrame([(s,)], "value string")
    assert tuple(text.event_log(one("gas; 12:30; puff ; me")).first()) == ("gas", "12:30", "puff", "me")
    assert tuple(text.linked_intervals(one('<a href="x?from=10&amp;upto=20">')).first()) == (10, 20)
    assert tuple(text.page_links(one('<a href="/d/2004-03-01">run day</a> <a href="x">no</a>')).first()) == ("20040301", "run day", "/d/2004-03-01")
    p = spark.createDataFrame([(1, '{"a": {"b": 3}, "c": "x"}')], "id long, t string")
    assert p.select(text.parameter(F.col("t"), "a/b"), text.parameter(F.col("t"), "a/z", "none")).first() == ("3", "none")
    assert text.parameter_names(p, "t", "id").count() == 2
    assert p.select(text.key_values(F.lit("a=1,b=2"))).first()[0] == {"a": "1", "b": "2"}
    t = spark.createDataFrame([("20040301",), ("20040301 12:30:00",), ("2004-03-01 12:30:00.25",), ("soon",)], "s string").select(text.time_ns(F.col("s"))).collect()
    assert [r[0] for r in t] == [1078099200 * 10**9, 1078144200 * 10**9, 1078144200 * 10**9 + 250_000_000, None]
    d = text.inferred(spark.createDataFrame([("1", "1.5", "x"), ("2", " ", "y")], "a string, b string, c string"), ["a", "b", "c"])
    assert [f.dataType.simpleString() for f in d.schema] == ["bigint", "double", "string"]


def test_binary(spark, tmp_path):
    a = np.zeros(5, dtype=[("timebase", "<f8"), ("channel_1", "<i2")])
    a["timebase"], a["channel_1"] = np.arange(5) / 10, np.arange(5) * 3
    (tmp_path / "x.bin").write_bytes(a.tobytes())
    (tmp_path / "y.bin.bz2").write_bytes(bz2.compress(a.tobytes()))
    rows = binary.records(spark, str(tmp_path), [("timebase", "<f8"), ("channel_1", "<i2")])
    assert rows.count() == 10 and rows.agg(F.sum("channel_1")).first()[0] == 60
    one = rows.where(F.col("file").endswith("x.bin"))
    assert binary.joined_records([one, one.select("file", "i", F.col("channel_1").alias("channel_2"))]).columns == ["i", "timebase", "channel_1", "channel_2"]
    spark.dataSource.register(binary.RecordFiles)
    got = spark.read.format("record_files").option("paths", str(tmp_path / "x.bin")).option("fields", "timebase:<f8,channel_1:<i2").load().collect()
    assert [r["channel_1"] for r in got] == [0, 3, 6, 9, 12]
    np.savez(tmp_path / "z.npz", s=np.arange(3), o=np.array([{}], dtype=object))
    (tmp_path / "n").mkdir()
    (tmp_path / "z.npz").rename(tmp_path / "n/z.npz")
    assert [(r["name"], r["values"]) for r in binary.npz_arrays(spark, str(tmp_path / "n")).collect()] == [("s", [0.0, 1.0, 2.0])]
    assert spark.range(1).select(binary.digitiser_volts(F.lit(4096), 13, 10.0)).first()[0] == 0.0


def test_archives(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"dimensions": [1, 2], "values": [3277.24, 0, 5], "datatype": "short", "label": "x", "unit": "V"}))
    got = archive.json_signals(spark, str(tmp_path / "s.json")).orderBy("i").collect()
    assert [(r["utc_ns"], round(r["signal"], 6)) for r in got] == [(1, 1.0), (2, 0.0)]
    shots = spark.createDataFrame([(20040301, 1, 5, 6, ""), (20040301, 2, 7, 8, ""), (20040301, 2, 9, 10, "")], "date int, progid int, start_utc long, end_utc long, comment string")
    wanted = spark.createDataFrame([(20040301, p) for p in (0, 1, 2, 3, 999)], "date int, progid int")
    got = {r["progid"]: (r["start_utc"], r["n"]) for r in archive.program_times(shots, wanted).collect()}
    day = 1078099200 * 10**9
    assert got == {0: (day, 0), 1: (5, 1), 2: (None, 2), 3: (None, 0), 999: (day + 86400 * 10**9, 0)}
    r = archive.Registry()
    r.register("sine")(lambda s, shot: text.sine(s, n=4, t0=0.0, sample_freq=4.0, amplitude=float(shot), frequency=1.0))
    assert r.getdata(spark, "sine", [1, 2]).count() == 8 and r.getdata(spark, "none", 1, missing_ok=True) is None
    with pytest.raises(LookupError, match="sine"):
        r.getdata(spark, "sime", 1)


def test_config(spark):
    c = Config()
    c.read_text("[variabletypes]\nn = int\nok = bool\n[Diagnostic:MP1]\nn = 3\nok = yes\nx = a\n[Device:H]\nname = q\n")
    c.read_text("[Diagnostic:MP1]\nx = b\n")
    assert c.section("Diagnostic", "MP1") == {"n": 3, "ok": True, "x": "b"}
    before = Config()
    before.read_text(c.history[-1])
    assert c.diff(before) == [("Diagnostic:MP1", "x", "b", "a")]
    c.undo()
    assert c.section("Diagnostic", "MP1")["x"] == "a" and c.table(spark).count() == 6
    with pytest.raises(LookupError, match="MP1"):
        c.section("Diagnostic", "MP2")
    with pytest.raises(ValueError):
        c.read_text("[Other:x]\na = 1\n")
    assert nearest_names("kitten", ["sitting", "kit", "mitten"])[0] == "mitten"
    assert valid_for([(10, 20, {"v": 1}), (None, None, {"v": 0})], 15) == {"v": 1} and valid_for([(10, 20, {"v": 1})], 5) is None


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 10, 1.5, [1.0, 2.0]), (2, 20, float("nan"), None)], "indx long, shot long, x double, p array<double>")
    path = str(tmp_path / "t")
    writers.save(df, path, columns=["indx", "shot"], by=["shot"])
    writers.replace_shots(spark.createDataFrame([(5, 20), (6, 20)], "indx long, shot long"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("indx", "shot").collect()) == [(1, 10), (5, 20), (6, 20)]
    with pytest.raises(Exception, match="(?i)exist"):
        writers.save(df, path)
    assert writers.with_added(df, df.select("indx", F.lit(1).alias("q"))).columns[-1] == "q"
    with pytest.raises(ValueError):
        writers.with_added(df, spark.createDataFrame([(1, 1)], "indx long, q int"))
    head, rows = writers.arff_lines(df, "t", {"p": 2})
    assert head[0] == "@RELATION t" and [r[0] for r in rows.collect()] == ["1,10,1.5,1.0,2.0", "2,20,?,?,?"]
    writers.write_csv(df, str(tmp_path / "c"), about={"shot": 1}, lengths={"p": 2})
    assert spark.read.option("header", True).csv(str(tmp_path / "c/rows")).columns == ["indx", "shot", "x", "p_0", "p_1"]
    m = writers.magnitude_phase(spark.createDataFrame([(3.0, 4.0)], "re double, im double"), "re", "im", "z").first()
    assert m["mag_z"] == 5.0
