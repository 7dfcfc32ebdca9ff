from driftwell.llm.leaks import align, find_leaks, positional_index, words
from pyspark.sql import functions as F

PASSAGE = (
    "Consider a torus in which 65 pickup coils see the gap mode with a lag of 3.21 degrees between neighbours. "
    "Were the H-alpha monitor replaced by a diamagnetic loop, the phase difference would reach 14.7 rather than 5.78 MW."
)
OTHER = "Suppose the Rogowski coil on Quill-3 is sampled every 21.8 microseconds while the true phase difference oscillates with the valve shut at noon."
FILL = "The night shift saw nothing new before the ramp and went home early. "
ITEMS = [(1, PASSAGE, "t"), (2, OTHER, "t"), (3, None, "t"), (4, "", "t"), (5, "Single", "t")]


def run(spark, texts, items=ITEMS, **more):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], "doc_id long, text string, item_id string, share string, doc string")
    tests = spark.createDataFrame(items, "item_id long, passage string, doc_id string")
    return sorted((r["doc_id"], r["item_id"]) for r in find_leaks(docs, tests, doc_id="doc_id", text="text", item_id="item_id", passage="passage", **more).collect())


def altered(every):
    w = PASSAGE.split()
    return " ".join("other" if i % every == 2 else x for i, x in enumerate(w))


def test_disguises_do_not_matter(spark):
    w = PASSAGE.split()
    texts = [
        PASSAGE.upper(), PASSAGE.replace(",", "").replace(".", "!"), FILL * 20 + PASSAGE + FILL, "  ".join(w), "\n".join(w), "> " + "\n> ".join(" ".join(w[i : i + 6]) for i in range(0, len(w), 6)),
        PASSAGE.replace("neighbours", "neigh-\nbours").replace("diamagnetic", "dia-\n> magnetic"), PASSAGE.replace("pickup", "<b>pickup</b>").replace(" see ", "&nbsp;see ").replace("mode", "*mode*"),
        '{"prompt": "' + PASSAGE.replace(". ", ".\\n") + '"}', PASSAGE.replace("replaced", "repla=\nced"), f'<p><a href="#c">{w[0]}</a> {" ".join(w[1:])}</p>',
    ]
    assert run(spark, texts) == [(i, 1) for i in range(len(texts))]


def test_parts_and_alterations(spark):
    w = PASSAGE.split()
    texts = [" ".join(w[5:21]), " ".join(w[5:20]), altered(6), altered(3), " ".join(x for i, x in enumerate(w) if i % 5), " ".join(w[:10]) + " " + FILL + " ".join(w[10:20]), FILL * 50, " ".join(sorted(w))]
    assert run(spark, texts) == [(0, 1), (2, 1), (3, 1), (4, 1)]


def test_every_second_word_altered_in_a_passage_that_is_everywhere(spark):
    w = PASSAGE.split()
    often = [PASSAGE + f" copy {k}" for k in range(30)] + [" ".join(f"w{k}{i}" if i % 2 else x for i, x in enumerate(w)) for k in range(30)]
    long = (PASSAGE + " " + OTHER).split()
    items = [(1, PASSAGE, ""), (7, " ".join(long), "")]
    dropped = " ".join(x for i, x in enumerate(long) if i % 2 == 0)
    got = run(spark, [*often, dropped, FILL], items)
    want = {(k, 1) for k in range(60)} | {(k, 7) for k in range(30)} | {(60, 7)}
    assert want <= set(got) and not [x for x in got if x[0] == 61]


def test_several_items_copies_nulls_and_long_texts(spark):
    texts = [PASSAGE + " " + OTHER, PASSAGE, PASSAGE, None, "", FILL * 15_000 + OTHER + FILL * 15_000, "日本語の文章だけ。", "Single"]
    assert run(spark, texts) == [(0, 1), (0, 2), (1, 1), (2, 1), (5, 2)]


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [PASSAGE], []) == []


def test_without_broadcasting_and_with_a_stored_index(spark, monkeypatch):
    from driftwell.llm import leaks

    want = run(spark, [PASSAGE, FILL, OTHER])
    monkeypatch.setattr(leaks, "BROADCAST_TERMS", 1)
    monkeypatch.setattr(leaks, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(leaks, "MARKS_AT_MOST", 0)
    assert run(spark, [PASSAGE, FILL, OTHER]) == want == [(0, 1), (2, 2)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([PASSAGE, FILL, OTHER])], "doc_id long, text string")
    assert run(spark, [PASSAGE, FILL, OTHER], index=positional_index(docs, "doc_id", "text")) == want


def test_short_passages(spark):
    items = [(1, "alpha beta gamma delta", ""), (2, "two words", "")]
    assert run(spark, ["one alpha beta gamma delta two words", "alpha beta gamma", "two wor ds"], items) == [(0, 1), (0, 2)]


def test_align():
    p = "a b c d e f".split()
    assert align(p, "x a b c d e f".split()) == (6, 6)
    assert align(p, "a b x d e f".split()) == (5, 3)
    assert align(p, "a b d e f".split()) == (5, 3)
    assert align(p, "a b x y e f".split()) == (2, 2)
    assert align([], ["a"]) == (0, 0)


def test_words(spark):
    got = spark.range(1).select(words(F.lit("A-b\tC,d  é.F &amp; 3.5 <br>x")).alias("w")).first()["w"]
    assert got == ["ab", "c", "d", "é", "f", "35", "x"]
