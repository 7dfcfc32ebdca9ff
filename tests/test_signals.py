import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.functions import circular as C
from driftwell.functions import fitting, numbers, spectra
from driftwell.operators import clustering, fluctuations, mining, probes
from driftwell.operators import series as S
from driftwell.sources import binary, text

MODES = [(0.7, 24_000.0, 3, 0.2), (0.5, 37_000.0, 4, 0.3)]


def test_two_modes_around_a_ring_become_two_structures(spark):
    rows = text.many_modes(spark, channels=10, n=512, step=1e-6 * 2, modes=MODES, noise=0.02).withColumn("shot", F.lit(1).cast("long"))
    segments = S.segment_arrays(S.segment(rows, ["shot", "channel"], "i", 512), ["shot"], channel="channel")
    for how in ("geometric", "threshold"):
        found = fluctuations.fluctuation_structures(segments, keys=["shot"], how=how, normalise=None).orderBy("fs_id").collect()
        first, second = found[0], found[1]
        assert (first["svs"], second["svs"]) == ([0, 1], [2, 3])
        assert first["freq"] == pytest.approx(24_000, abs=1000) and second["freq"] == pytest.approx(37_000, abs=1000)
        assert first["p"] == pytest.approx(0.49 / 0.74, abs=0.02) and second["p"] == pytest.approx(0.25 / 0.74, abs=0.02)
        assert np.allclose(first["dphase"], C.TWO_PI * 3 / 10, atol=0.1) and np.allclose(second["dphase"], C.TWO_PI * 4 / 10, atol=0.15)
        assert first["svs_mask"] == 3 and first["a12"] > 0.9


def test_all_vectors_rebuild_the_signal():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 64))
    topos, s, chronos, h, e = spectra.decompose(x)
    assert np.allclose(np.einsum("gc,g,gt->ct", topos, s, chronos), x)
    assert e == pytest.approx((x**2).sum()) and 0 < h <= 1


def test_bad_segments_give_nothing(spark):
    rows = [(1, 0, 0.0, 0.1, [[1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0]]), (1, 1, 0.0, 0.1, [[1.0, float("nan"), 3.0, 4.0]] * 2), (1, 2, 0.0, None, [[1.0] * 8] * 2), (1, 3, 0.0, 0.1, [[1.0] * 8]), (1, 4, 0.0, 0.1, [[1.0] * 8] * 3)]
    df = spark.createDataFrame(rows, "shot long, seg_id long, t0 double, dt double, signal array<array<double>>")
    assert fluctuations.fluctuation_structures(df, keys=["shot"]).count() == 0


def test_bandpass_keeps_the_band():
    t = np.arange(1000) / 1000
    x = np.sin(2 * np.pi * 50 * t) + np.sin(2 * np.pi * 200 * t)
    y = spectra.bandpass(x, 1e-3, (40, 60), (25, 75))[0]
    assert np.abs(y - np.sin(2 * np.pi * 50 * t))[50:-50].max() < 0.1
    with pytest.raises(ValueError):
        spectra.bandpass(x, 1e-3, (20, 60), (25, 75))
    for taper in (1, 2):
        m = spectra.band_mask(512, (0.3, 0.4), (0.2, 0.5), taper)
        assert m.max() == 1 and m.min() == 0 and m[int(0.35 * 256)] == 1


def test_butterworth_gain():
    for kind, edges, high, low in (("lowpass", 0.2, 0.02, 0.8), ("highpass", 0.4, 0.8, 0.02), ("bandpass", (0.2, 0.4), math.sqrt(0.2 * 0.4), 0.9)):
        b, a = spectra.butterworth(4, edges, kind)
        gain = lambda w: abs(np.polyval(b, np.exp(1j * np.pi * w)) / np.polyval(a, np.exp(1j * np.pi * w)))  # noqa: E731, B023
        assert gain(high) == pytest.approx(1, abs=0.03) and gain(low) < 0.05
        edge = np.atleast_1d(edges)[0]
        assert gain(edge) == pytest.approx(1 / math.sqrt(2), abs=1e-6)
    x = np.random.default_rng(0).normal(size=(2, 40))
    b, a = spectra.butterworth(2, 0.3, "lowpass")
    y = np.zeros_like(x)
    for n in range(40):
        y[:, n] = sum(b[k] * x[:, n - k] for k in range(3) if n >= k) - sum(a[k] * y[:, n - k] for k in range(1, 3) if n >= k)
    assert np.allclose(spectra.recursive_filter(b, a, x), y)
    assert spectra.butterworth_order([0.2], [0.4], 3, 30) == 5


def test_phase_delay_and_damping():
    t = np.arange(256)
    assert np.allclose(np.diff(spectra.analytic_phase(np.cos(2 * np.pi * t / 16))[0]), 2 * np.pi / 16, atol=1e-6)
    x = np.random.default_rng(3).normal(size=256)
    assert spectra.time_delay(np.roll(x, 7), x, 0.5) == 3.5
    y = np.exp(-0.05 * t[:120]) * np.exp(1j * 0.9 * t[:120])
    d, w = np.array([0.0, 0.05, 0.1]), np.linspace(0.5, 1.3, 17)
    i, j = np.unravel_index(spectra.damped_music(y, 1, 30, d, w).argmax(), (3, 17))
    assert (d[i], w[j]) == (0.05, pytest.approx(0.9))


def test_nice_numbers():
    assert [numbers.next_nice_number(n) for n in (1, 2, 3, 7, 256, 257, 1000)] == [1, 2, 3, 8, 256, 288, 1024]
    assert numbers.prime_factors(360) == [2, 2, 2, 3, 3, 5] and numbers.nice_length(1021, 10) == 1024
    assert numbers.split_names(["MP_A01", "MP_A02", "MP_A07"], 2) == ("MP_A", ["01", "02", "07"], "")
    assert numbers.compact_numbers([3, 1, 2, 7]) == "1-3,7" and numbers.last_where(10, lambda i: i < 4) == 3
    assert numbers.subdivide([1.0, 3.0], 0.0, 0.0, 10.0) == [(0.0, 2.0), (2.0, 10.0)]


def test_fits():
    x = np.linspace(0, 4, 80)
    p, r = fitting.fit_curve("gaussian_pedestal", x, 3 * np.exp(-((x - 2) ** 2) / (2 * 0.5**2)) + 1)
    assert np.allclose(np.abs(p), [3, 2, 0.5, 1], atol=1e-4) and r < 1e-5
    p, r = fitting.fit_curve("exponential", x, 5 * np.exp(-x / 0.8) + 2)
    assert np.allclose(p, [5, 0.8, 2], atol=1e-4)
    v = np.linspace(-60, 40, 120)
    for norm, tolerance in ((2.0, 1e-3), (1.0, 0.2)):
        f = fitting.fit_probe(v, fitting.probe_current(v, 20.0, 5.0, 0.004), norm=norm)
        assert f["te"] == pytest.approx(20, rel=tolerance) and f["vf"] == pytest.approx(5, rel=tolerance)
    with pytest.raises(ValueError):
        fitting.fit_probe(v[:3], v[:3])
    best, cost, _ = fitting.simplex(lambda q: (q[0] - 1) ** 2 + (q[1] + 2) ** 2, [0, 0], [1, 1])
    assert np.allclose(best, [1, -2], atol=1e-3) and cost < 1e-6


def test_circular_functions():
    k = np.array([0.5, 2.0, 10.0, 200.0])
    assert np.allclose(C.kappa_from_resultant(C.bessel_ratio(k)), k, rtol=1e-6)
    assert np.allclose(C.log_i0(np.array([0.0, 1.0])), [0, math.log(1.2660658777520082)])
    assert np.isfinite(C.log_i0(np.array([5000.0]))).all()
    assert C.kappa_to_sigma(np.array([100.0]))[0] == pytest.approx(0.1, abs=0.002)


def mixture_rows(spark, n=600):
    rng = np.random.default_rng(2)
    rows = []
    for c, mu in enumerate(([0.5, -2.0], [3.0, 1.0], [-1.5, 3.1])):
        for i in range(n // 3):
            a = [float((m + rng.normal(0, 0.2) + math.pi) % C.TWO_PI - math.pi) for m in mu]
            rows.append((c * 1000 + i, a, float(rng.normal(10 * c, 0.5))))
    return spark.createDataFrame(rows, "id long, phases array<double>, freq double")


@pytest.mark.parametrize("method", ["k-means", "k_means_periodic", "EM_VMM", "EM_VMM_GMM", "EM_GMM"])
def test_clusterings_find_the_three(spark, method):
    df = mixture_rows(spark)
    numbers_ = ["freq"] if method in ("EM_GMM", "EM_VMM_GMM") else []
    got = clustering.cluster(df, method, 3, row_id="id", angles=None if method == "EM_GMM" else "phases", length=0 if method == "EM_GMM" else 2, numbers=numbers_).collect()
    pairs = {(r["id"] // 1000, r["cluster"]) for r in got}
    assert len(got) == 600 and len(pairs) == 3 and len({c for _, c in pairs}) == 3
    with pytest.raises(ValueError):
        clustering.cluster(df, "other", 3, row_id="id")


def test_mode_lists_and_comparison(spark):
    df = mixture_rows(spark)
    stats = clustering.von_mises_of(df, F.expr("cast(id div 1000 as int)"), "phases")
    modes = {r["cluster"]: r for r in clustering.mode_list(stats).collect()}
    assert len(modes) == 3 and modes[0]["centre"] == pytest.approx([0.5, -2.0], abs=0.05) and modes[0]["spread"] == pytest.approx([0.2, 0.2], abs=0.03)
    a = df.select("id", F.expr("cast(id div 1000 as int)").alias("cluster"))
    assert all(r["best"] and r["n"] == 200 for r in clustering.contingency(a, a).collect())


def test_probe_sweeps(spark):
    rows = [(s, float(v), float(fitting.probe_current(np.array([v]), 10.0 + s, 2.0, 0.003)[0])) for s in range(3) for v in range(-50, 30)] + [(9, 1.0, 1.0)]
    got = {r["s"]: r for r in probes.fit_sweeps(spark.createDataFrame(rows, "s long, v double, i double"), ["s"], voltage="v", current="i").collect()}
    assert got[2]["te"] == pytest.approx(12.0, rel=1e-3) and got[9]["te"] is None


def test_quantise_round_trip():
    rng = np.random.default_rng(1)
    for v in (rng.integers(0, 4000, 500) * 0.0025 - 3, rng.normal(size=300), np.array([2.0, 2.0]), np.array([1.0, np.nan, 3.0]), np.array([np.nan])):
        q = binary.quantise(v)
        back = binary.dequantise(q["start"], q["quantum"], q["raw"])
        assert (np.isnan(back) == np.isnan(v)).all()
        assert np.nanmax(np.abs(back - v), initial=0) <= 3.1e-6 * max(1e-300, np.nanmax(np.abs(v), initial=0), np.ptp(v[~np.isnan(v)]) if (~np.isnan(v)).any() else 0)
    assert binary.quantise(np.arange(100) * 0.5)["raw"].dtype == np.uint8
    assert binary.read_formula("temp=cumsum(-1.5e-3 + raw*2.0)") == (-0.0015, 2.0, True)
    with pytest.raises(ValueError):
        binary.read_formula("__import__('os')")


def test_table_operators(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "b")], "indx long, `x-y` double, z string")
    assert mining.legal_names(df).columns == ["indx", "xy", "z"]
    with pytest.raises(KeyError):
        mining.append_rows(df, df.drop("z"))
    assert mining.append_rows(df, df).count() == 4
    new = spark.createDataFrame([(1, "c", 5)], "indx long, z string, w int")
    assert {r["indx"]: (r["z"], r["w"]) for r in mining.update_columns(df, new, "indx").collect()} == {1: ("c", 5), 2: (None, None)}


def test_shapes_and_scans(spark):
    from driftwell.operators import shots as H

    df = spark.createDataFrame([("b", 1, 0.1, 0.2), ("a", 2, 0.3, 0.4), ("c", 3, 0.0, 1.0)], "name string, shot int, t0 double, t1 double")
    assert [(r["shot"], r["place"]) for r in H.scan_details(df, ["a", "b"]).orderBy("place").collect()] == [(2, 0), (1, 1)]
    xyz = spark.range(1).select(*H.along_line(F.lit(5.0), (0, 0, 0), (0, 10, 0))).first()
    assert tuple(xyz) == (0.0, 5.0, 0.0)
    assert spark.range(1).select(H.energy_of(F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0)), F.array(F.lit(0), F.lit(1)))).first()[0] == 25.0
    edges = H.equal_count_edges([0.0] * 3, [1.0] * 3, 4)
    assert len(edges) == 5 and edges == sorted(edges)
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    assert [tuple(r) for r in H.differing_rows(a, a.distinct()).collect()] == [(1, "x", "a", 1)] and H.differing_rows(a, a).count() == 0
    noisy = H.with_noise(spark.range(4000).select(F.lit(1).alias("k"), F.lit(2.0).alias("v")), "v", ["k"], 20.0)
    assert noisy.agg(F.stddev("v")).first()[0] == pytest.approx(0.2, rel=0.1)
    labels = spark.createDataFrame([(i, i % 2, 0.9 if i < 4 else 0.4) for i in range(8)], "id long, cluster int, weight double")
    stats = spark.createDataFrame([(0, 9.0), (1, 2.0)], "cluster int, kappa double")
    assert sorted(r["id"] for r in H.cutoff_members(labels, stats, min_kappa=4.0, min_weight=0.5).collect()) == [0, 2]
    c = spark.createDataFrame([("A", None), ("B", "s2"), ("C", None)], "channel string, section_sweep string")
    w = spark.createDataFrame([("A", "s1")], "channel string, sweep string")
    assert {r["channel"]: r["sweep"] for r in H.sweep_of(c, w, F.lit("s0")).collect()} == {"A": "s1", "B": "s2", "C": "s0"}


def test_upserts_and_centroids(spark):
    from driftwell.operators import shots as H

    left = spark.createDataFrame([(1, 5, 10.0), (2, 6, 20.0), (3, 7, 30.0)], "l long, shot int, e double")
    right = spark.createDataFrame([(100, 5, 0.0), (200, 6, 0.0)], "r long, shot int, e double")
    m = spark.createDataFrame([(1, 1, 100), (2, 2, None), (3, 0, None)], "l long, matches long, r long")
    got = {(r["r"], r["shot"]): r["e"] for r in H.upsert_matched(right, left, m, left_id="l", right_id="r", columns=["e"]).collect()}
    assert got == {(100, 5): 10.0, (200, 6): 0.0, (None, 7): 30.0}
    rng = np.random.default_rng(4)
    angles = np.mod(rng.normal(3.0, 0.6, 60), 2 * np.pi)
    row = H.circular_centroid(spark.createDataFrame([(1, float(a)) for a in angles], "k int, a double"), ["k"], "a").first()
    grid = np.linspace(-np.pi, np.pi, 20001)
    cost = ((np.mod(angles[None, :] - grid[:, None] + np.pi, 2 * np.pi) - np.pi) ** 2).sum(axis=1)
    assert row["cost"] == pytest.approx(cost.min(), rel=1e-4) and row["centre"] == pytest.approx(grid[cost.argmin()], abs=1e-3)
