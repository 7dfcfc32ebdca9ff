import numpy as np
from pyspark.sql import functions as F

from driftwell.functions.forest import scores
from driftwell.operators.implausible import implausible

SCHEMA = "src long, ch string, rid long, t double, v double, score string, flagged string"


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    out = implausible(df, source=[F.col("src")], time="t", value="v", reading_id="rid", impossible=F.abs("v") > 100, channel=F.col("ch"), **more)
    return {r["reading_id"]: r["flagged"] for r in out.collect()}


def series(src, n, seed, f=lambda t: 0.0, ch="c"):
    rng = np.random.default_rng(seed)
    return [[src, ch, src * 10_000 + i, i * 0.01, round(float(f(i) + rng.normal(0, 0.1)), 4)] for i in range(n)]


def planted():
    rows, bad = [], set()
    for s, f in enumerate((lambda i: 5.0, lambda i: 3 * np.sin(i / 25), lambda i: 5.0 if i < 90 else 9.0, lambda i: i * 0.02)):
        r = series(s, 180, s, f)
        for k, by in ((20, 3.0), (70, -2.5), (71, -3.0), (120, 4.0), (121, 3.0), (122, 5.0)):
            r[k][4] += by
            bad.add(r[k][2])
        for k in range(140, 152):
            r[k][4] = r[140][4]
            bad.add(r[k][2])
        r[160][4] = 1e9
        bad.add(r[160][2])
        rows += r
    return [tuple(r) for r in rows], bad


def test_finds_what_was_planted_and_no_more(spark):
    rows, bad = planted()
    got = run(spark, rows)
    assert {k for k, f in got.items() if f} == bad
    assert len(got) == len(rows)


def test_a_long_source_is_judged_as_if_it_were_not_cut(spark):
    rows, bad = planted()
    rows += [rows[5], rows[100]]
    whole, cut = run(spark, rows), run(spark, rows, longest=70)
    assert cut == whole and {k for k, f in cut.items() if f} == bad


def test_a_hot_source_at_one_time_is_cut_too(spark):
    rng = np.random.default_rng(3)
    rows = [(1, "c", i, 7.0, round(float(rng.normal(0, 0.1)), 4)) for i in range(900)]
    rows[400] = (1, "c", 400, 7.0, 9.0)
    assert [k for k, f in run(spark, rows, longest=200).items() if f] == [400]


def test_valves_have_only_impossible_values(spark):
    rows = [(9, "valve", i, float(i), float(7 + 3 * (i // 25))) for i in range(200)]
    rows[60] = (9, "valve", 60, 60.0, 500.0)
    rows[80] = (9, "valve", 80, 80.0, 40.0)
    assert [k for k, f in run(spark, rows).items() if f] == [60]


def test_nulls_repeats_empty_and_constant(spark):
    nan = float("nan")
    assert run(spark, []) == {}
    rows = [(1, "c", 1, None, 1.0), (1, "c", 2, 0.1, None), (1, "c", 3, 0.2, nan), (1, "c", None, 0.3, 1.0), (1, "c", 5, 0.4, 500.0), (1, "c", 5, 0.4, 500.0), (None, None, 6, 0.1, 1.0)]
    got = run(spark, rows)
    assert got == {5: True, 6: False}


def test_forest_ranks_the_odd_one_first():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(0, 1, (300, 3)))
    x[17] = 9
    s = scores(x, np.zeros(300, dtype=int), 1, np.ones((300, 64), dtype=int), np.array([5], dtype=np.uint64), np.full(3, 0.5), np.ones(3), sample=64)
    assert s.argmax() == 17 and 0 < s.min() and s.max() < 1


def test_copies_of_a_row_are_one_row_with_a_number():
    x = np.array([[0.0], [0.0], [0.0], [5.0]])
    many = scores(x, np.zeros(4, dtype=int), 1, np.ones((4, 8), dtype=int), np.array([1], dtype=np.uint64), np.ones(1), np.ones(1), sample=4)
    one = scores(x[2:], np.zeros(2, dtype=int), 1, np.array([[3] * 8, [1] * 8]), np.array([1], dtype=np.uint64), np.ones(1), np.ones(1), sample=4)
    assert np.allclose(many[2:], one)


def test_forest_of_nothing():
    assert len(scores(np.zeros((0, 2)), np.zeros(0, dtype=int), 0, np.zeros((0, 8), dtype=int), np.zeros(0, dtype=np.uint64), np.ones(2), np.ones(2), sample=8)) == 0
