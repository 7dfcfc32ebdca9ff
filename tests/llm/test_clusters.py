import numpy as np
from pyspark.sql import functions as F

from driftwell.llm.clusters import Field, Settings, cluster_records, describe_clusters, successive_members

FIELDS = [Field("freq"), Field("kh"), Field("rms", log10=True)]
SCHEMA = "indx long, campaign int, freq double, kh double, rms double, cluster string, part string"


def make(seed=0, sizes=(600, 300, 120, 40), strays=25):
    rng = np.random.default_rng(seed)
    centres = [(20, 0.2, -3), (60, 0.9, -2), (95, 0.3, -1.5), (40, 0.6, -4)]
    rows, truth = [], []
    for g, (n, (f, k, r)) in enumerate(zip(sizes, centres, strict=True)):
        for _ in range(n):
            rows.append((rng.normal(f, 1.5), rng.normal(k, 0.015), 10 ** rng.normal(r, 0.05)))
            truth.append(g)
    for _ in range(strays):
        rows.append((rng.uniform(2, 120), rng.uniform(0.01, 1.1), 10 ** rng.uniform(-4.5, -0.5)))
        truth.append(-1)
    order = rng.permutation(len(rows))
    return [tuple(map(float, rows[i])) for i in order], [truth[i] for i in order]


def label(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return cluster_records(df, record_id="indx", part=F.col("campaign"), fields=FIELDS, **more)


def test_groups_and_strays_of_two_parts(spark):
    rows, truth = [], {}
    for c in (1, 2):
        values, t = make(c)
        rows += [(c * 10_000 + i, c, *v, "x", "y") for i, v in enumerate(values)]
        truth |= {c * 10_000 + i: (c, g) for i, g in enumerate(t)}
    got = label(spark, rows).cache()
    by = {}
    for r in got.collect():
        by.setdefault((r["part"], r["cluster"]), []).append(truth[r["record_id"]])
    groups = {k: v for k, v in by.items() if k[1] >= 0}
    assert len(groups) == 8
    assert all(len(set(v)) == 1 for v in groups.values())
    assert sum(map(len, groups.values())) >= 0.998 * 2 * 1060
    sizes = {(r["part"], r["cluster"]): (r["size"], len(r["typical"])) for r in describe_clusters(got).collect()}
    assert sizes == {k: (len(v), 5) for k, v in groups.items()}
    pairs = {(r["part"], r["cluster"], r["a"], r["b"]) for r in successive_members(got, stripe=37).collect()}
    want = set()
    ids = {}
    for r in got.where("cluster >= 0").collect():
        ids.setdefault((r["part"], r["cluster"]), []).append(r["record_id"])
    for k, v in ids.items():
        v.sort()
        want |= {(*k, a, b) for a, b in zip(v, v[1:])}
    assert pairs == want


def test_unknown_values_belong_to_none(spark):
    values, _ = make(3)
    rows = [(i, 1, *v, "x", "y") for i, v in enumerate(values)]
    nan = float("nan")
    odd = [(9001, 1, None, 0.2, 1e-3, "", ""), (9002, 1, nan, 0.2, 1e-3, "", ""), (9003, 1, 20.0, 0.2, 0.0, "", ""), (9004, 1, 20.0, 0.2, -1.0, "", ""), (9005, None, 20.0, 0.2, 1e-3, "", ""), (9006, 1, float("inf"), 0.2, 1e-3, "", "")]
    got = {r["record_id"]: (r["cluster"], r["distance"]) for r in label(spark, rows + odd).collect()}
    assert len(got) == len(rows) + 6
    assert all(got[k] == (-1, None) for k in range(9001, 9007))


def test_empty_equal_and_few_records(spark):
    assert label(spark, []).count() == 0
    same = label(spark, [(i, 1, 20.0, 0.2, 1e-3, "", "") for i in range(30)]).collect()
    assert {r["cluster"] for r in same} == {0}
    few = label(spark, [(i, 1, 20.0 + i, 0.2, 1e-3, "", "") for i in range(3)]).collect()
    assert {r["cluster"] for r in few} == {-1}


def test_text_fields_are_hashed(spark):
    df = spark.createDataFrame([(i, 1, "red" if i % 2 else "blue") for i in range(80)], "id long, p int, colour string")
    got = cluster_records(df, record_id="id", part=F.col("p"), fields=[Field("colour", text=True)], settings=Settings(centres=8)).collect()
    assert {(r["record_id"] % 2, r["cluster"]) for r in got} in ({(0, 0), (1, 1)}, {(0, 1), (1, 0)})


def test_a_small_group_is_found_in_a_large_part(spark):
    rng = np.random.default_rng(5)
    big = [(20, 0.2, -3), (60, 0.9, -2), (95, 0.3, -1.5), (40, 0.6, -4)]
    rows = [(*rng.normal(big[i % 4], (1.5, 0.015, 0.05)), i % 4) for i in range(120_000)]
    rows += [(rng.uniform(2, 120), rng.uniform(0.01, 1.1), rng.uniform(-4.5, -0.5), -1) for _ in range(4000)]
    rows += [(*rng.normal((80, 0.8, -2.8), (0.8, 0.008, 0.03)), 4) for _ in range(14)]
    got = label(spark, [(i, 1, float(f), float(k), float(10**r), "x", "y") for i, (f, k, r, _) in enumerate(rows)]).collect()
    members = {}
    for r in got:
        members.setdefault(r["cluster"], []).append(rows[r["record_id"]][3])
    groups = [v for k, v in members.items() if k >= 0]
    assert sorted(max(set(v), key=v.count) for v in groups) == [0, 1, 2, 3, 4]
    small = next(v for v in groups if 4 in v)
    assert small.count(4) == 14 and len(small) <= 16


def groups_on_a_lattice(shape, n, seed):
    rng = np.random.default_rng(seed)
    rows, truth = [], []
    for g, (a, b, c) in enumerate(np.ndindex(*shape)):
        for _ in range(n):
            rows.append((float(rng.normal(10 + 20 * a, 0.8)), float(rng.normal(0.1 + 0.2 * b, 0.008)), float(10 ** rng.normal(-4 + 0.8 * c, 0.03)), "x", "y"))
            truth.append(g)
    return rows, truth


def test_more_groups_than_centres(spark):
    for shape, n in (((5, 5, 3), 40), ((4, 2, 2), 10)):
        rows, truth = groups_on_a_lattice(shape, n, 2)
        members = {}
        for r in label(spark, [(i, 1, *r) for i, r in enumerate(rows)]).where("cluster >= 0").collect():
            members.setdefault(r["cluster"], []).append(truth[r["record_id"]])
        assert len(members) == max(truth) + 1
        assert all(len(set(v)) == 1 and len(v) >= 0.9 * n for v in members.values())
