"""Co-training of two views that don't overlap: accuracy of each on held-out rows, before and after the rounds."""

import random

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n, seed, told_by_text=0.9):
    """Good pages come from some sources and bad ones from others; most bad texts shout, some don't."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    rows, truth = [], {}
    for i in range(n):
        good = rng.random() < 0.6
        text = [rng.choice(words) for _ in range(rng.randrange(30, 90))]
        if not good and rng.random() < told_by_text:
            text = [w + "!!" if rng.random() < 0.5 else w for w in text]
        source = f"{'good' if good == (rng.random() < 0.95) else 'bad'}{rng.randrange(10)}"
        rows.append((i, " ".join(text), rng.choice(["en", "fr"]), source, 1000 if good else 4000))
        truth[i] = int(good)
    return rows, truth


def accuracies(model, rows, truth):
    a = np.array([quality.text_view(r[1]) for r in rows])
    b = np.array([model.slots.view([r[2], r[3]], [r[4]]) for r in rows])
    y = np.array([truth[r[0]] for r in rows])
    each = [float(((z > 0) == y).mean()) for z in model.calibrated((a, b))]
    return *each, float(((model.scores((a, b)) >= 0.5) == y).mean())


def test_views_teach_each_other(spark):
    rows, truth = corpus(3000, 1)
    # the few labels come from two sources, so the record's view knows no other at first
    some = [i for i, r in enumerate(rows) if r[3] in ("good0", "bad0")][:120]
    rows = [(i, t, la, s, 2000) for i, t, la, s, _ in rows]  # and the size tells nothing
    labels = spark.createDataFrame([(i, truth[i]) for i in some], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, SCHEMA)
    held = [r for r in rows if r[0] not in set(some)]
    before, after = (accuracies(quality.fit(docs, labels, rounds=n), held, truth) for n in (0, 3))
    assert after[0] >= before[0] - 0.01 and after[2] >= before[2] - 0.01 and after[2] >= 0.9, (before, after)


def test_both_views_beat_either(spark):
    rows, truth = corpus(2400, 2, told_by_text=0.8)
    labels = spark.createDataFrame([(i, truth[i]) for i in range(800)], "doc_id long, quality int")
    rows = [(i, t, la, s, 2000) for i, t, la, s, _ in rows]
    model = quality.fit(spark.createDataFrame(rows, SCHEMA), labels)
    text, record, both = accuracies(model, rows[800:], truth)
    assert 0.85 <= text <= 0.97 and 0.9 <= record <= 0.97 and both > max(text, record), (text, record, both)


def test_views_are_separate():
    slots = quality.Slots((("en",), ("web", "src0")))
    assert (slots.view(["en", "web"], [5]) == slots.view(["en", "web"], [5])).all() and slots.width == 2 + 3 + 21
    assert (slots.view(["en", "web"], [5]) != slots.view(["en", "src0"], [5])).sum() == 2 and (slots.view(["xx", None], [None]).sum()) == 3
    assert len(quality.text_view("")) == len(quality.text_view("a b\nc " * 500))


def test_edges(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", -5), (2, "x y", "en", "a", 1), (None, "good text here", "en", "a", 9), (3, "bad!! bad!!", "fr", "b", 9)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("accepted", F.lit("old")).withColumn("x", F.lit(1)).withColumn("y", F.lit(2))
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, None), (None, 0)], "doc_id long, quality int")
    got = quality.score_documents(df, quality.fit(df, labels)).collect()
    assert len(got) == 5 and all(0 <= r["quality_score"] <= 1 and r["y"] == 2 for r in got)
    empty = df.limit(0)
    assert quality.score_documents(empty, quality.fit(empty, labels)).count() == 0
    assert quality.score_documents(df.select("doc_id", "text"), quality.fit(df.select("doc_id", "text"), labels)).count() == 5
