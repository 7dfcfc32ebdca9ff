import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell import registry as G
from driftwell.functions.sweeps import longest_low
from driftwell.operators import correlation as R
from driftwell.operators import fluctuations as X
from driftwell.operators import lookups as L
from driftwell.operators import selection as W


def test_expressions_are_arithmetic_only():
    for bad in ("__import__('os')", "signal; drop", "reflect('a','b')", "other + 1", "signal ** 2", "", "'x'"):
        with pytest.raises(ValueError):
            G.expression(bad, ["signal"])


def test_unknown_names(spark):
    df = spark.range(3)
    with pytest.raises(LookupError):
        G.apply(df, [("nothing", {})])
    with pytest.raises(LookupError):
        G.transformed(df, "a", "b", ["id"], ["x"])
    with pytest.raises(LookupError):
        G.reduced(df, [], {"x": ("nothing", "id")})
    with pytest.raises(LookupError):
        W.members(df.withColumn("cluster", F.lit(1)), 7, row_id="id")
    with pytest.raises(LookupError):
        W.of_channels(df, ["a", "a"])


def test_thinning_is_even_and_repeats(spark):
    df = spark.range(20_000).withColumnRenamed("id", "i")
    a, b = (sorted(r[0] for r in W.thinned(df, -2000, row_id="i").collect()) for _ in range(2))
    c = sorted(r[0] for r in W.thinned(df, 2000, row_id="i", seed=5).collect())
    assert a == b != c and abs(len(a) - 2000) < 100 and abs(len(c) - 2000) < 100 and abs(np.mean(a) - 10_000) < 300
    assert W.thinned(df.limit(0), -10, row_id="i").count() == 0


def test_settings_of_highest_priority_hold(spark):
    shots = spark.createDataFrame([(1,), (5,), (9,), (None,)], "shot long")
    s = spark.createDataFrame([(None, 6, 0, "a"), (4, 8, 1, "b")], "first_shot long, last_shot long, priority int, value string")
    got = {r["shot"]: r["value"] for r in L.valid_setting(shots, s, row_id="shot").collect()}
    assert got == {1: "a", 5: "b", 9: None, None: None}


def test_correlation_of_known_signals(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    y = 0.5 * x + rng.normal(size=200)
    rows = [(1, float(a), float(b)) for a, b in zip(x, y)] + [(1, float("nan"), 1.0), (2, 1.0, None)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    got = {r["k"]: r["correlation"] for r in R.zero_lag(df, ["k"], "x", "y").collect()}
    assert abs(got[1] - np.corrcoef(x, y)[0, 1]) < 1e-12 and 2 not in got
    one = R.products(df, ["k"], "x", "y").where("k = 1").first()
    assert one["n"] == 200 and abs(one["product"] - np.correlate(x, y, "valid")[0]) < 1e-9


def test_peaks_of_a_spectrum_by_brute_force(spark):
    t = np.arange(64) * 0.001
    x = np.stack([np.sin(2 * np.pi * 125 * t + p) + 0.3 * np.sin(2 * np.pi * 250 * t) for p in (0.0, 0.7, 1.4)])
    df = spark.createDataFrame([(7, 0, 0.0, 0.001, x.tolist()), (7, 1, 0.0, 0.001, [[1.0, 2.0], [1.0]]), (7, 2, 0.0, 0.001, [])], "shot long, seg_id long, t0 double, dt double, signal array<array<double>>")
    got = X.spectral_features(df, keys=["shot"], n_points=2, lower=10.0).orderBy("place").collect()
    z = np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * np.hanning(64), axis=1)
    p = (np.abs(z) ** 2).mean(axis=0)
    mean = np.array([p[max(0, i - 2) : i + 3].sum() / 5 for i in range(len(p))])
    best = sorted(range(len(p)), key=lambda i: -(p - mean)[i])[:2]
    assert [r["freq"] for r in got] == [i / 0.064 for i in best] and abs(got[0]["freq"] - 125) < 16
    assert np.allclose(got[0]["phases"], np.angle(z[:, best[0]])) and len(got[0]["dphase"]) == 2


def test_peaks_of_spectra_of_fewer_than_five_components(spark):
    rng = np.random.default_rng(3)
    signals = {n: rng.normal(size=(3, n)) for n in range(4, 12)}
    df = spark.createDataFrame([(7, n, 0.0, 0.001, x.tolist()) for n, x in signals.items()], "shot long, seg_id long, t0 double, dt double, signal array<array<double>>")
    got = X.spectral_features(df, keys=["shot"], n_points=3).collect()
    for n, x in signals.items():
        z = np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * np.hanning(n), axis=1)
        p = (np.abs(z) ** 2).mean(axis=0)
        peaked = np.array([p[i] - p[max(0, i - 2) : i + 3].sum() / 5 for i in range(len(p))])
        best = np.argsort(-peaked)[:3]
        rows = sorted((r for r in got if r["seg_id"] == n), key=lambda r: r["place"])
        assert np.allclose([r["freq"] for r in rows], best / (n * 0.001)) and np.allclose([r["peakedness"] for r in rows], peaked[best])
        assert np.allclose([r["phases"] for r in rows], np.angle(z[:, best]).T)


def test_pulse_at_a_level_between():
    t = np.arange(100.0)
    x = np.where((t >= 30) & (t < 60), 1.0, np.where(t % 10 == 0, 0.045, 0.001))
    assert longest_low(t, x) == (30.0, 59.0, 1 / 22)


def test_profile_through_few_points(spark):
    pts = spark.createDataFrame([(float(i) / 10, float(i) ** 2 / 100) for i in range(20)], "z double, r double")
    got = W.slope_profile(pts, along="z", across="r", degree=2).orderBy("z").collect()
    assert all(abs(r["slope"] - 2 * r["z"]) < 1e-9 for r in got)
    assert W.slope_profile(pts.limit(0), along="z", across="r").count() == 0
