import math
import random

from driftwell.operators.gridding import regular_grid

SCHEMA = "sid long, t double, v double, dt double, rid long, cell_no string, level string"


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    out = regular_grid(df, source="sid", time="t", value="v", step="dt", reading_id="rid", **more).collect()
    return {(r["sid"], r["cell_no"]): r for r in out}


def brute(rows, hold=1.0):
    out, groups = {}, {}
    for s, t, v, d, i in {r for r in rows}:
        if None in (s, t, v, d) or any(map(math.isnan, (t, v))) or any(map(math.isinf, (t, v))) or d <= 0:
            continue
        groups.setdefault(s, []).append((t, v, i, d))
    for s, g in groups.items():
        g.sort()
        d = g[0][3]
        first, last = math.floor(g[0][0] / d), math.floor(g[-1][0] / d)
        for c in range(first, last + 1):
            w = vw = 0.0
            level, n = None, 0
            for k, (t, v, _, _) in enumerate(g):
                until = g[k + 1][0] if k + 1 < len(g) else t
                n += math.floor(t / d) == c
                if t < (c + 1) * d and math.floor(t / d) <= c:
                    level = v
                h = max(0.0, min(until, t + hold * d, c * d + d) - max(t, c * d))
                w, vw = w + h, vw + h * v
            out[s, c] = (level, vw / w if w > 0 else None, min(1.0, w / d), n)
    return out


def same(got, want):
    assert set(got) == set(want)
    for k, (level, mean, cover, n) in want.items():
        r = got[k]
        assert (r["n_readings"], r["level"]) == (n, level), (k, r, want[k])
        assert abs(r["coverage"] - cover) < 1e-9
        assert (r["mean"] is None) == (mean is None) or abs((r["mean"] or 0.0) - (mean or 0.0)) < 1e-9


def test_against_brute_force_in_small_and_large_spans(spark):
    rng = random.Random(2)
    rows = []
    for s in range(5):
        t = -1.03
        for i in range(80):
            t += rng.choice([0.004, 0.011, 0.02, 0.35])
            rows.append((s, round(t, 4), rng.choice([1.0, 2.5, -3.0]), 0.01 * (s + 1), s * 1000 + i))
    want = brute(rows)
    for span in (4, 7, 2048):
        same(run(spark, rows, span=span), want)


def test_holds_longer_when_told(spark):
    rows = [(1, 0.001, 4.0, 0.01, 1), (1, 0.045, 6.0, 0.01, 2)]
    same(run(spark, rows, hold_steps=3.0, span=2), brute(rows, 3.0))


def test_unusable_repeated_and_single_readings(spark):
    nan = float("nan")
    rows = [(1, None, 1.0, 0.1, 1), (1, 0.05, None, 0.1, 2), (1, 0.05, nan, 0.1, 3), (1, nan, 1.0, 0.1, 4), (None, 0.5, 1.0, 0.1, 5), (1, 0.5, 1.0, 0.0, 6), (1, 0.5, 1.0, None, 7), (1, float("inf"), 1.0, 0.1, 8)]
    assert run(spark, rows) == {}
    one = [(7, 0.55, 3.0, 0.1, 1), (7, 0.55, 3.0, 0.1, 1)]
    got = run(spark, one)
    assert [(k, r["n_readings"], r["mean"], r["coverage"]) for k, r in got.items()] == [((7, 5), 1, None, 0.0)]


def test_empty_cells_are_marked_and_faulty_readings_fill(spark):
    rows = [(1, 0.0, 1e9, 1.0, 1), (1, 3.2, 1.0, 1.0, 2)]
    got = run(spark, rows)
    assert [c for (_, c), r in sorted(got.items()) if r["n_readings"] == 0] == [1, 2]
    assert got[1, 1]["level"] == 1e9


def test_empty_table(spark):
    assert run(spark, []) == {}
