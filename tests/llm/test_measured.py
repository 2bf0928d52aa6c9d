"""Measurements on the small tables of the data folder, where they are at hand."""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import minhash, quality, toxicity

D = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no data folder")


def test_every_pair_of_the_threshold_is_in_one_class(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    bags = {i: Counter(tuple(w[k : k + 5]) for w in [(t or "").lower().split()] for k in range(max(1, len(w) - 4))) for i, t in rows}
    holders = defaultdict(list)
    for i, b in bags.items():
        for g in b:
            holders[g].append(i)
    near = {(a, b) for h in holders.values() if 1 < len(h) for x, a in enumerate(h) for b in h[x + 1 :]}
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    links, below = 0, 0
    for a, b in near:
        both = sum((bags[a] & bags[b]).values())
        s = both / (sum(bags[a].values()) + sum(bags[b].values()) - both)
        links += s >= 0.8
        below += 0.5 <= s < 0.8
        assert s < 0.8 or got[a] == got[b]
    assert links >= 90, (links, below)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet") if os.path.isdir("/root/testdata/sf0.1") else spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet") if os.path.isdir("/root/testdata/sf0.1") else spark.read.parquet(f"{D}/labels.parquet")
    net = toxicity.fit(docs, labels)
    held = toxicity.held_out(F.col("doc_id"))
    got = toxicity.score_documents(docs.where(held), net).join(labels, "doc_id").select("predicted", "toxic").toPandas()
    wrong = (got.predicted != got.toxic).mean()
    found = got[got.toxic == 1].predicted.mean()
    assert wrong <= 0.02 and found >= 0.88, (wrong, found, len(got))
    seen, rest = labels.where(~held), labels.where(held)
    model = quality.fit(docs, seen)
    scored = quality.score_documents(docs, model).join(rest, "doc_id").select("accepted", "quality").toPandas()
    right = (scored.accepted == (scored.quality == 1)).mean()
    rows = docs.join(rest, "doc_id").select("text", "lang", "source", "n_chars", "quality").collect()
    y = np.array([r["quality"] for r in rows])
    xs = np.array([quality.text_view(r["text"] or "") for r in rows]), np.array([model.slots.view([r["lang"], r["source"]], [r["n_chars"]]) for r in rows])
    text, record = (float(np.mean((z > 0) == y)) for z in model.calibrated(xs))
    print("toxic", wrong, found, "quality", right, text, record)
    assert right >= 0.95 and text >= 0.95, (right, text, record)
