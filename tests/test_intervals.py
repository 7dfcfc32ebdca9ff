import random

from driftwell.operators.intervals import continuous_periods

SCHEMA = "day int, prog int, s long, e long, kind string, start_utc string"


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in continuous_periods(df, ["day", "prog"], "s", "e", **more).collect())


def brute(rows):
    out, groups = [], {}
    for d, p, s, e in rows:
        if s is not None and e is not None and e >= s:
            groups.setdefault((d, p), []).append((s, e))
    for k, v in groups.items():
        merged = []
        for s, e in sorted(v):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(*k, "period", s, e) for s, e in merged]
        out += [(*k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out)


BASE = 1_078_125_000_000_000_000


def test_touching_nested_and_one_ns_apart(spark):
    rows = [(1, 1, BASE, BASE + 10), (1, 1, BASE + 10, BASE + 20), (1, 1, BASE + 21, BASE + 30), (1, 1, BASE + 22, BASE + 23), (1, 2, BASE, BASE + 5)]
    assert run(spark, rows) == brute(rows)


def test_nulls_wrong_order_empty_intervals_and_repeats(spark):
    rows = [(1, 1, None, BASE), (1, 1, BASE, None), (1, 1, BASE + 9, BASE), (1, 1, BASE + 50, BASE + 50), (1, 1, BASE, BASE + 4), (1, 1, BASE, BASE + 4), (1, 1, BASE + 4, BASE + 4)]
    assert run(spark, rows) == [(1, 1, "gap", BASE + 4, BASE + 50), (1, 1, "period", BASE, BASE + 4), (1, 1, "period", BASE + 50, BASE + 50)]


def test_empty_table_and_null_keys(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, 1, 5, 6, "", ""), (None, 1, 6, 8, "", "")], SCHEMA)
    assert [tuple(r) for r in continuous_periods(df, ["day", "prog"], "s", "e").collect()] == [(None, 1, "period", 5, 8)]


def test_bundles_do_not_show_and_a_hot_key_is_whole(spark):
    rng = random.Random(4)
    rows = [(1, 1, s := rng.randrange(0, 20_000), s + rng.randrange(0, 30)) for _ in range(800)] + [(2, p, s := rng.randrange(0, 500), s + rng.randrange(-3, 30)) for p in range(8) for _ in range(20)]
    assert run(spark, rows, bundle=100) == brute(rows) == run(spark, rows, bundle=10**9)


def test_negative_times(spark):
    rows = [(1, 1, -30, -20), (1, 1, -20, -5), (1, 1, -3, 4)]
    assert run(spark, rows, bundle=7) == brute(rows)


def test_bounds_as_far_as_numbers_go(spark):
    far = 2**63 - 1
    rows = [(1, 1, -far, -far + 5), (1, 1, 4, far), (1, 1, 7, 9), (2, 1, -far, far), (2, 1, far, far), (3, 1, far - 2, far - 1), (3, 1, far, far)]
    assert run(spark, rows) == brute(rows)


def test_one_interval_covers_many_bundles(spark):
    rows = [(1, 1, 0, 5000)] + [(1, 1, k * 100 + 50, k * 100 + 60) for k in range(48)] + [(1, 1, 4990, 5020), (1, 1, 5021, 5030), (1, 1, 9000, 9001)]
    assert run(spark, rows, bundle=100) == brute(rows)
