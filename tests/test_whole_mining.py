"""Registered mining queries over more texts and longer ones than the default limits, against plain models."""

import random
from collections import Counter

import pytest

from threadloom.plans.queries import QUERIES


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(5, 9))) for _ in range(n)]


def grams(text):
    w = text.split()
    every = (" ".join(w[i : i + k]) for k in range(2, 13) for i in range(len(w) - k + 1))
    return Counter(g for g in every if 16 <= len(g) <= 384)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    v = vocabulary(rng, 400)
    texts = [" ".join(rng.choice(v) for _ in range(3)) for _ in range(4100)]
    texts[4050] = texts[4060] = "onlybehindthe fourthousandth text"
    texts[4070] = texts[4080] = "value = behind(the, fourthousandth)"
    texts[7] = " ".join(rng.choice(v) for _ in range(4200)) + " thelastwords ofalongtext thelastwords ofalongtext"
    d = str(tmp_path_factory.mktemp("mining"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d, texts


def test_counts_of_the_whole_table(spark, corpus):
    d, texts = corpus
    want = sum((grams(t) for t in texts), Counter())
    got = {r["phrase"]: r["cnt"] for r in QUERIES["ngram_counts"](spark, d).collect()}
    assert got == {g: n for g, n in want.items() if n >= 2}
    assert got["onlybehindthe fourthousandth"] == 2 and got["thelastwords ofalongtext"] == 2
    assert {r["phrase"]: r["cnt"] for r in QUERIES["code_lines"](spark, d).collect()} == {"value = behind(the, fourthousandth)": 2}
    assert [r["phrase"] for r in QUERIES["code_line_topk"](spark, d).collect()] == ["value = behind(the, fourthousandth)"]
    assert [r["phrase"] for r in QUERIES["ngram_tokens"](spark, d).collect()] == ["value = behind(the, fourthousandth)"]
    for name in ("phrase_stats", "phrase_hits"):
        stats = {r["phrase"]: r["p_cnt"] for r in QUERIES[name](spark, d).where("p_cnt >= 2").select("phrase", "p_cnt").collect()}
        assert stats == got
    assert {"onlybehindthe fourthousandth", "thelastwords ofalongtext"} <= {r["phrase"] for r in QUERIES["phrase_scores"](spark, d).where("kind = 'phrase'").collect()}
