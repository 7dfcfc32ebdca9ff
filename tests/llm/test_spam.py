import random

from driftwell.llm.pages import NAMES, features
from driftwell.llm.spam import spam_pages

WORDS = "coil probe wire flange pump gauge tip lens cable filter turbo source".split()


def sentence(rng):
    return rng.choice([
        "The operator moved the probe by {} mm, and the mode of the coil drifts slowly.", "If the gauge reads below {} Pa, the fit of the curve is not to be trusted.",
        "We compared the camera with the bolometer and found that it was off by {}.", "Für den nächsten Tag sind {} Schüsse mit einem anderen Feld geplant.", "密度は{}まで上がったが、コイル電流は一定だった。",
    ]).format(rng.randrange(2, 99))


def page(kind, rng):
    pick = lambda n: [rng.choice(WORDS) for _ in range(n)]
    if kind == "stuffed":
        return " ".join(pick(120))
    if kind == "links":
        return "\n".join(f"{' '.join(pick(2))} http://{rng.choice(WORDS)}-shop.test/p?id={rng.randrange(999)}" for _ in range(25))
    if kind == "offers":
        return "\n".join(f"SKU {rng.randrange(10000, 99999)} ; {' '.join(pick(2))} NEW {rng.randrange(9, 900)}.{rng.randrange(10, 99)}" for _ in range(20))
    if kind == "tags":
        return " ".join("#" + "".join(pick(2)) for _ in range(50))
    if kind == "spaced":
        return " ".join(" ".join(w) if rng.random() < 0.5 else w.replace("o", "0").replace("i", "1").replace("e", "3") for w in pick(60))
    if kind == "table":
        return "shot freq amp\n" + "\n".join(f"{rng.uniform(0, 900):.4g} {rng.uniform(0, 9):.4g} {rng.uniform(0, 90):.4g}" for _ in range(30))
    if kind == "channels":
        return "Channel list\n" + "\n".join(f"{rng.choice('MNI')}P_{rng.choice('AB')}{k:02d}  gain {rng.choice([1, 2, 5])} V  area {rng.uniform(1, 9):.3g}e-06  full scale {rng.choice([0.05, 10.0, 24.0])}" for k in range(12))
    if kind == "shots":
        return "The shots of the day:\n" + " ".join(f"2004{rng.randrange(1000, 1231)}.{rng.randrange(1, 150)}" for _ in range(40))
    if kind == "glossary":
        return "\n".join(f"{w}: {sentence(rng)}" for w in pick(6))
    if kind == "code":
        return "def run(x):\n" + "\n".join(f"    {a} = {b}[{rng.randrange(9)}:]" for a, b in zip(pick(15), pick(15)))
    if kind == "some_links":
        return " ".join(sentence(rng) for _ in range(9)) + "\nSee also:\n" + "\n".join(f"* [{w}](http://wiki.test/{rng.randrange(99)})" for w in pick(3))
    return " ".join(sentence(rng) for _ in range(rng.randrange(1, 12)))


BAD, GOOD = ("stuffed", "links", "offers", "tags", "spaced"), ("prose", "prose", "table", "channels", "shots", "glossary", "code", "some_links")


def run(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "doc_id long, text string, site string, score string, host string, page_id string")
    return {r["doc_id"]: r for r in spam_pages(df, page_id="doc_id", text="text", host="site").collect()}


def test_held_out_pages(spark):
    rng = random.Random(5)
    kinds = [rng.choice(BAD) if rng.random() < 0.2 else rng.choice(GOOD) for _ in range(600)]
    got = run(spark, [(i, page(k, rng), f"h{i % 9}" if i % 11 else None) for i, k in enumerate(kinds)])
    wrong = [i for i, k in enumerate(kinds) if (got[i]["score"] > 0.5) != (k in BAD)]
    assert len(got) == 600 and len(wrong) <= 6, [(kinds[i], got[i]["score"]) for i in wrong]
    assert all(got[i]["host_rate"] is None for i in range(0, 600, 11))


def test_hosts_move_scores_but_not_clear_ones(spark):
    rng = random.Random(6)
    rows = [(i, page("stuffed", rng), "bad") for i in range(60)] + [(100 + i, page("prose", rng), "good") for i in range(200)] + [(999, page("prose", rng), "bad")]
    got = run(spark, rows)
    assert got[999]["host_rate"] > got[100]["host_rate"] and got[999]["score"] < 0.5
    assert all(got[i]["score"] > 0.5 for i in range(60))


def test_nulls_empty_and_one_class(spark):
    assert run(spark, []) == {}
    got = run(spark, [(1, None, "h"), (2, "", "h"), (3, "...", None), (4, "The coil is not in the vessel and we do not know why it was moved.", "h")])
    assert {k: r["score"] for k, r in got.items() if k < 4} == {1: 0.0, 2: 0.0, 3: 0.0} and got[4]["score"] < 0.5


def test_long_text_and_features():
    x = dict(zip(NAMES, features("coil probe " * 200_000), strict=True))
    assert x["top_words"] == 1.0 and x["prose"] == 0
    assert features(None) is None and features("") is None and features("!!!") is None
