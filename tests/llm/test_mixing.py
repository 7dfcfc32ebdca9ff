import pytest

from driftwell.llm.mixing import budgets, mix_sources, token_count
from pyspark.sql import functions as F

DOCS = "doc_id long, source string, text string, copies string, tokens string"
TARGETS = "source string, target_share double, max_repeats int, extra string"


def run(spark, docs, targets, **more):
    d = spark.createDataFrame([(*r, "x", "y") for r in docs], DOCS)
    t = spark.createDataFrame([(*r, "z") for r in targets], TARGETS)
    a, b = mix_sources(d, t, doc_id="doc_id", source="source", text="text", **more)
    return {r["doc_id"]: r for r in a.collect()}, {r["source"]: r for r in b.collect()}


def corpus():
    rows = [(i, " Big" if i % 3 else "BIG", f"a long text about probe number {i} and its sweep " * (1 + i % 4)) for i in range(400)]
    rows += [(1000 + i, "small", f"a short note {i} on coils ") for i in range(40)]
    rows += [(2000 + i, "un-wanted", f"spam {i}") for i in range(20)]
    return rows


def test_shares_and_repeats(spark):
    used, shares = run(spark, corpus(), [("big", 0.7, 1), ("small", 0.3, 4), ("un_wanted", 0.0, 1), ("absent", 0.1, 2)])
    assert shares["big"]["actual_share"] == pytest.approx(0.7, abs=0.01) and shares["small"]["actual_share"] == pytest.approx(0.3, abs=0.01)
    assert shares["absent"]["used_tokens"] == 0 and shares["un_wanted"]["used_tokens"] == 0
    assert max(r["copies"] for r in used.values() if r["source"] == "small") <= 4 and {r["copies"] for r in used.values() if r["source"] == "big"} == {1}
    assert sum(r["copies"] * r["tokens"] for r in used.values()) == sum(r["used_tokens"] for r in shares.values())
    assert not any(r["source"] == "un_wanted" for r in used.values())


def test_epochs_come_before_a_fraction(spark):
    used, shares = run(spark, corpus(), [("small", 1.0, 5)], total_tokens=1e9)
    assert {r["copies"] for r in used.values()} == {5} and len(used) == 40
    whole = shares["small"]["available_tokens"]
    used, shares = run(spark, corpus(), [("small", 1.0, 5)], total_tokens=2.5 * whole)
    assert {r["copies"] for r in used.values()} == {2, 3}
    assert shares["small"]["used_tokens"] == pytest.approx(2.5 * whole, abs=10)


def test_scarce_sources_fall_short_of_a_total(spark):
    _, shares = run(spark, corpus(), [("big", 0.5, 1), ("small", 0.5, 1)], total_tokens=4000)
    assert shares["small"]["short"] and shares["small"]["used_tokens"] == shares["small"]["available_tokens"]


def test_quality_weighs(spark):
    rows = [(i, "s", "plain words of good text here now") for i in range(300)]
    rows = [(i, "s", f"plain words of good text here now {'x' * (i % 7)} {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(300)]
    rows += [(1000 + i, "s", f"##!! 0{i} 1{i} 2{i} %% $$ 3{i} 9{i} ~~ ;; 4{i}") for i in range(300)]
    used, _ = run(spark, rows, [("s", 1.0, 1)], total_tokens=2500)
    good = sum(k < 1000 for k in used)
    assert good > 4 * (len(used) - good)


def test_copies_nulls_and_empty(spark):
    rows = [(1, "s", "the same text"), (2, "s", "the same text"), (3, "s", None), (4, "s", ""), (5, None, "no source"), (None, "s", "no id"), (6, "t", "other words")]
    used, _ = run(spark, rows, [("s", 1.0, 3), (None, 0.5, 1), ("t", None, None)])
    assert {k: r["copies"] for k, r in used.items()} == {1: 3}
    used, shares = run(spark, [], [("s", 1.0, 3)])
    assert used == {} and shares["s"]["actual_share"] == 0
    assert run(spark, rows, [])[0] == {}


def test_budgets():
    b = {x.source: x for x in budgets({"a": 100, "b": 10}, {"a": (0.5, 2), "b": (0.5, 4), "c": (0.2, 1)})}
    assert (b["a"].tokens, b["b"].tokens, b["b"].epochs) == (40, 40, 4)
    assert b["c"].tokens == 0 and budgets({}, {"a": (1.0, 1)})[0].tokens == 0


def test_whole_texts_are_counted(spark):
    one, many = spark.range(1).select(token_count(F.lit("coil current ")).alias("a"), token_count(F.lit("coil current " * 5000)).alias("b")).first()
    assert many > 4000 * one / 2
