import pytest

from driftwell.functions.units import mentioned, parse, to_common
from driftwell.operators.conversion import to_common_units


@pytest.mark.parametrize(
    ("text", "quantity", "common", "factor", "offset"),
    [
        ("mA", "current", "A", 1e-3, 0), ("MA", "current", "A", 1e6, 0), ("kiloamp", "current", "A", 1e3, 0), ("Ampere", "current", "A", 1, 0), ("mT", "field", "T", 1e-3, 0),
        ("kG", "field", "T", 0.1, 0), ("G", "field", "T", 1e-4, 0), ("hPa", "pressure", "Pa", 100, 0), ("mbar", "pressure", "Pa", 100, 0), ("keV", "temperature", "eV", 1e3, 0),
        ("cm^-3", "density", "1e18 m^-3", 1e-12, 0), ("1e19 m^-3", "density", "1e18 m^-3", 10, 0), ("per cc", "density", "1e18 m^-3", 1e-12, 0), ("10^19/m3", "density", "1e18 m^-3", 10, 0),
        ("°C", "wall_temp", "K", 1, 273.15), ("deg C", "wall_temp", "K", 1, 273.15), ("fahrenheit", "wall_temp", "K", 5 / 9, 255.3722222), ("µs", "time", "s", 1e-6, 0), ("min", "time", "s", 60, 0),
    ],
)
def test_units(text, quantity, common, factor, offset):
    got = to_common(text, quantity, common)
    assert got == pytest.approx((factor, offset), rel=1e-9)


def test_priors_decide_between_readings():
    assert parse("mT", "field").dimension == (("field", 1),)
    assert parse("min", "time").factor == 60
    assert to_common("V", "current", "A") is None


@pytest.mark.parametrize("text", ["?", "see params", "", "range", "checked", "12", "x" * 500])
def test_senseless(text):
    assert all(to_common(text, q, c) is None for q, c in (("voltage", "V"), ("field", "T"), ("pressure", "Pa")))


def test_mentions_but_not_remarks():
    assert mentioned("isolated by 500 V, y/mV, amp 2 x 10 V range", "voltage") == "mV"
    assert mentioned("isolated by 500 V; cable 50 ohm | trigger -6 ms pre", "voltage") is None
    assert mentioned("clk 100 kHz external\nt [µs]", "time") == "µs"
    assert mentioned("trigger -6 ms pre", "time") is None
    assert mentioned("amp 2 x 10 V range", "current") is None


SCHEMA = "save_id long, quantity string, peak_raw double, units string, params string, scales array<double>, tu double, t_last double, unit string, factor string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    common = spark.createDataFrame([("current", "A"), ("wall_temp", "K")], "quantity string, common_unit string")
    out = to_common_units(df, record_id="save_id", quantity="quantity", value="peak_raw", units="units", text="params", scales="scales", time_unit="tu", times=["t_last"], common=common)
    return {r["record_id"]: r for r in out.collect()}


def test_operator(spark):
    nan = float("nan")
    got = run(spark, [
        (1, "current", 2.0, "kA", "t/ms", [2.0, -1.0], None, 5.0), (2, "current", 2.0, None, "y/mA", None, 60.0, 1.0), (3, "wall_temp", 20.0, " degC ", None, [], -1.0, 1.0),
        (4, "current", 2.0, "A", None, [], 1.0, 1.0), (5, None, 2.0, "A", None, None, 1.0, 1.0), (6, "colour", 2.0, "A", None, None, 1.0, 1.0), (7, "current", nan, "A", None, [None, 3.0], nan, nan),
        (8, "current", None, None, None, None, None, None), (1, "current", 2.0, "kA", "t/ms", [2.0, -1.0], None, 5.0), (None, "current", 1.0, "A", "", None, 1.0, 1.0),
    ])
    assert len(got) == 8
    assert (got[1]["value_common"], got[1]["t_last_s"], got[1]["stated_in"]) == (-4000.0, 0.005, "units")
    assert (got[2]["value_common"], got[2]["t_last_s"], got[2]["stated_in"]) == (pytest.approx(0.002), 60.0, "text")
    assert got[3]["value_common"] == pytest.approx(293.15) and got[3]["seconds_per_unit"] == 1.0
    assert [got[k]["converted"] for k in (1, 2, 3, 4)] == [True, True, True, False]
    assert got[5]["value_common"] is None and got[6]["value_common"] is None
    assert got[7]["scale"] == 3.0 and got[7]["value_common"] is None and got[7]["t_last_s"] is None
    assert got[8]["value_common"] is None and got[8]["converted"] is False


def test_empty(spark):
    assert run(spark, []) == {}
