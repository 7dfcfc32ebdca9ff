import random

from pyspark.sql import functions as F

from driftwell.llm.nearest import nearest_in_time


def run(spark, left, right, **more):
    a = spark.createDataFrame(left, "lid long, shot long, ch string, t double, tol double")
    b = spark.createDataFrame(right, "rid long, shot long, ch string, t double, tol double")
    keys = [F.col("shot"), F.col("ch")]
    out = nearest_in_time(a, b, left_id="lid", right_id="rid", left_entity=keys, right_entity=keys, left_time="t", right_time="t", tolerance="tol", **more)
    return sorted((r["lid"], r["rid"]) for r in out.collect())


def brute(left, right):
    out = []
    for i, s, c, t, tol in left:
        best = None
        for r, s2, c2, t2, _ in right:
            if (s, c) == (s2, c2) and t2 is not None and t is not None:
                key = (abs(t - t2), t2 > t, r)
                if best is None or key < best:
                    best = key
        if best and best[0] <= tol:
            out.append((i, best[2]))
    return sorted(out)


def test_against_brute_force_with_a_hot_entity(spark):
    rng = random.Random(1)
    left = [(i, rng.choice([1, 1, 1, 2]), rng.choice("ab"), round(rng.uniform(-1, 3), 5), 0.01) for i in range(300)]
    right = [(i, rng.choice([1, 1, 1, 2]), rng.choice("ab"), round(rng.uniform(-1, 3), 5), 0.01) for i in range(900)]
    want = brute(left, right)
    for width in (1.0, 3.0, 256.0):
        assert run(spark, left, right, slice_width=width) == want


def test_ties_take_the_earlier_reading_and_the_smaller_id(spark):
    left = [(1, 1, "a", 1.0, 0.5), (2, 1, "a", 5.0, 0.5)]
    right = [(9, 1, "a", 0.75, 0.5), (3, 1, "a", 1.25, 0.5), (7, 1, "a", 5.0, 0.5), (6, 1, "a", 5.0, 0.5), (6, 1, "a", 5.0, 0.5)]
    assert run(spark, left, right) == [(1, 9), (2, 6)]


def test_tolerance_is_included(spark):
    assert run(spark, [(1, 1, "a", 1.0, 0.5), (2, 1, "a", 1.0, 0.25)], [(4, 1, "a", 1.5, 0.5)]) == [(1, 4)]


def test_nulls_and_nan_match_nothing(spark):
    nan = float("nan")
    good = (1, 1, "a", 1.0, 0.5)
    left = [good, (2, None, "a", 1.0, 0.5), (3, 1, None, 1.0, 0.5), (4, 1, "a", None, 0.5), (5, 1, "a", nan, 0.5), (6, 1, "a", 1.0, None), (7, 1, "a", 1.0, nan), (8, 1, "a", float("inf"), 0.5)]
    right = [(1, 1, "a", 1.1, 0.5), (2, None, "a", 1.0, 0.5), (3, 1, "a", None, 0.5), (4, 1, "a", nan, 0.5), (None, 1, "a", 1.0, 0.5)]
    assert run(spark, left, right) == [(1, 1)]


def test_zero_tolerance_and_empty_tables(spark):
    assert run(spark, [(1, 1, "a", 1.0, 0.0)], [(4, 1, "a", 1.0, 0.0), (5, 1, "a", 1.1, 0.0)]) == [(1, 4)]
    assert run(spark, [], [(1, 1, "a", 1.0, 0.5)]) == [] == run(spark, [(1, 1, "a", 1.0, 0.5)], [])


def test_clashing_names(spark):
    a = spark.createDataFrame([(1, 1, "a", 1.0, 0.5, "x")], "lid long, shot long, ch string, t double, tol double, distance string").withColumn("rid", F.lit("z"))
    b = spark.createDataFrame([(2, 1, "a", 1.0, 0.5, "x")], "rid long, shot long, ch string, t double, tol double, lid string")
    keys = [F.col("shot"), F.col("ch")]
    out = nearest_in_time(a, b, left_id="lid", right_id="rid", left_entity=keys, right_entity=keys, left_time="t", right_time="t", tolerance="tol").collect()
    assert [tuple(r) for r in out] == [(1, 2, 0.0)]
