"""Fingerprints of whole and edited texts, and classes within a Hamming radius, against plain models."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import simhash as S


def _words(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % 4000}" for _ in range(n))


def _plain_print(text):
    """One term at a time, over sets of words and runs of three."""
    from threadloom.llm import _words as W

    words, counts = W.word_hashes([text])
    bag = {}
    for n in (1, 3):
        runs, _ = W.shingles(words, counts, n)
        for r in runs:
            h = int(W.mix(np.array([r]) + np.uint64(n))[0]) >> 20
            bag[h] = bag.get(h, 0) + 1
    votes = [0] * 256
    for h, t in bag.items():
        for j in range(4):
            x = int(W.mix(np.array([h], np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))[0]).to_bytes(8, "little")
            for b in range(64):
                votes[64 * j + b] += round(16 * (1 + np.log(t))) * (1 if x[b // 8] >> (7 - b % 8) & 1 else -1)
    return "".join(f"{sum((votes[8 * k + b] > 0) << (7 - b) for b in range(8)):02x}" for k in range(32))


def test_digests_against_a_plain_model(spark):
    rng = random.Random(3)
    rows = [(i, _words(rng, rng.choice([0, 1, 2, 7, 40, 300]))) for i in range(60)]
    rows += [(17, "another text of one id"), (17, "another text of one id"), (70, None), (71, ""), (72, "größe — 模型 \U0001f600 x"), (73, "a " * 4000)]
    docs = spark.createDataFrame([(i, t, 5, "en") for i, t in rows], "doc_id long, text string, near_next int, fingerprint string").repartition(5)
    got = S.digest_documents(docs).collect()
    h = {t: r[0] for t, r in zip([t or "" for _, t in rows], spark.createDataFrame([(t or "",) for _, t in rows], "t string").select(F.xxhash64("t")).collect())}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], h[r[1]]))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), _plain_print(t), _plain_print(e), _plain_print(n)))
    same = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 256
    assert sorted(tuple(r) for r in got) == sorted((i, n, x, a, b, same(a, b), same(a, c)) for i, n, x, a, b, c in want)


def test_one_row_follows_itself_and_none_gives_none(spark):
    one = S.digest_documents(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one[0]["near_next"] == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.fingerprint_documents(empty).collect() == []
    ids = S.fingerprint_documents(spark.createDataFrame([(None, "x y"), (None, None), (2, "x y")], "doc_id long, text string")).collect()
    assert len(ids) == 3 and {r["class_id"] for r in ids if r["n_chars"] == 3} == {2} and [r["class_id"] for r in ids if r["n_chars"] == 0] == [None]


def test_every_pair_within_the_radius_is_in_one_class(spark):
    rng = np.random.default_rng(4)
    prints = [rng.integers(0, 256, 32, dtype=np.uint8) for _ in range(40)]
    for p in list(prints):
        for k in (0, 1, 3, 6, 7, 8, 9, 20):
            q = np.unpackbits(p)
            q[rng.choice(256, k, replace=False)] ^= 1
            prints.append(np.packbits(q))
    hub = np.unpackbits(prints[0])
    for i in range(300):  # a large group around one, mostly further from each other than from it
        q = hub.copy()
        q[rng.choice(256, 5, replace=False)] ^= 1
        prints.append(np.packbits(q))
    rows = [(i, p.tobytes().hex()) for i, p in enumerate(prints)] + [(9000, None)]
    for radius, pick in ((7, 1), (3, 2)):
        got = {r["doc_id"]: r["class_id"] for r in S.near_classes(spark.createDataFrame(rows, "doc_id long, fingerprint string"), radius, pick).collect()}
        a = np.array(prints).view(np.uint64)
        near = np.bitwise_count(a[:, None] ^ a[None]).sum(axis=2) <= radius
        root = list(range(len(prints)))
        for _ in range(len(prints)):
            new = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(prints))]
            if new == root:
                break
            root = new
        assert [got[i] for i in range(len(prints))] == root and got[9000] is None


def test_half_edited_texts_are_nearer_than_others(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, _words(rng, 200)) for i in range(120)], "doc_id long, text string")
    got = S.digest_documents(docs).toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.97
    assert got.near_edited.mean() > got.near_next.mean() + 0.1
