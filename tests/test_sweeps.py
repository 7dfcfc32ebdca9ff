import numpy as np
import pytest

from driftwell.functions import sweeps as W


def test_cycles_and_lowpass():
    t = np.arange(4096) / 4096
    v = np.sin(2 * np.pi * 12 * t)
    assert W.sweep_cycles(v) == 12 and W.sweep_cycles(0.8 * v + np.sin(2 * np.pi * 24 * t)) == 12
    slow = W.gaussian_lowpass(v + np.sin(2 * np.pi * 900 * t), v, 10.0)[0]
    assert np.abs(slow - v).max() < 0.02


def test_leakage_is_removed():
    n = 6000
    t = np.arange(n) / n
    v, q = np.sin(2 * np.pi * 60 * t), np.cos(2 * np.pi * 60 * t)
    plasma = np.where(t > 0.6, 0.5 * np.clip(v, -1, 0.2), 0)
    clean, g = W.remove_leakage(0.03 * v + 0.01 * q + 0.2 + plasma, v, slice(0, 3000))
    assert abs(g.real - 0.03) < 1e-4 and np.abs(clean - plasma)[100:-100].max() < 2e-3
    with pytest.raises(ValueError):
        W.remove_leakage(v, v, slice(0, 100))


def test_clipped_sine_is_restored():
    t = np.arange(2000) * 1e-4
    x = 2 * np.sin(2 * np.pi * 50 * t) + 0.3
    cut = np.clip(x, -1.2, 1.5)
    y = W.restore_sine(cut, 1e-4, 50.0, clipped=(cut != x))
    # the ends of the record bend the band, the middle does not
    assert np.abs(y - x)[500:-500].max() < 0.1 and np.abs(y - x).mean() < 0.1 < 0.5 * np.abs(cut - x).max()


def test_pulses():
    t = np.linspace(0, 1, 200)
    x = np.where((t > 0.3) & (t < 0.7), 1.0, 0.0)
    assert W.longest_low(t, x) == pytest.approx((0.3, 0.7, 0.01), abs=0.01) and W.longest_low(t, 0 * x) is None
    assert W.pulse_by_duty(t, x, threshold=50.0) == pytest.approx((0.3, 0.7), abs=0.01)
    assert np.isnan(W.pulse_by_duty(t, 0 * t, threshold=1.0, passes=3)[0])


def test_profiles():
    x = np.linspace(-1, 1, 30)
    c, e = W.profile_quality(x, 1 - x**2, np.ones(30))
    assert e < 1e-9 and np.polyval(c, 0.0) == pytest.approx(1)
    assert W.profile_quality(x[:4], x[:4], np.ones(4))[1] == 9 and W.profile_quality(x, 0 * x, np.ones(30))[1] == 10
