"""Repeated ids in the near-duplicate stage."""

import random

import corpus_pipeline


def test_repeated_ids_with_unlike_texts_stay(spark):
    rng = random.Random(4)
    a, b, c = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(3))
    rows = [(7, a), (7, b), (7, a), (9, b), (3, c), (8, c + " more"), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()))
    assert got == sorted([(7, a), (7, b), (3, c), (0, a), (0, a)])
