"""Phrases against a plain count of every n-gram, also where the sketch is far too small."""

import re
import random
from collections import Counter

from threadloom.llm import collocations as C


def _plain(rows, words=3, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        score, cut = min((1_000_000 * a * a // (f[lang, p[:c]] * f[lang, p[c:]]), c) for c in range(1, len(p)))
        inside = any(q[i : i + len(p)] == p and 100 * b >= share * a for (m, q), b in f.items() if m == lang and len(q) > len(p) for i in range(len(q) - len(p) + 1))
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def _rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{k}é" for k in range(30)] + ["of", "The", "a b", "\U0001f600"]
    rows = []
    for _ in range(400):
        said = []
        for _ in range(rng.randint(0, 60)):
            said.append(vocabulary[int(rng.paretovariate(0.8)) % len(vocabulary)] if rng.random() < 0.85 else "New  York\tcity hall")
            said.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ; "]))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), "".join(said)))
    return rows + [(None, None), ("en", ""), ("fr", "..,;\n"), ("en", "x y " * 3000)]


def _got(spark, rows, **more):
    df = spark.createDataFrame([(lang, t, 1) for lang, t in rows], "lang string, text string, rank int").repartition(5)
    return sorted(tuple(r) for r in C.mine_phrases(df, **({"log": 18} | more)).collect())


def test_against_plain_counts(spark):
    rows = _rows(1)
    want = _plain(rows)
    assert len(want) > 50 and _got(spark, rows) == want
    assert _got(spark, rows, log=10) == want  # every cell is full: nothing is pruned, nothing lost
    assert _got(spark, rows, words=4, min_count=5, top=20, share=80) == _plain(rows, 4, 5, 80, 20)
    assert _got(spark, rows, min_count=300) == _plain(rows, least=300)  # cells beyond a byte


def test_edges(spark):
    assert _got(spark, []) == []
    assert _got(spark, [("en", None), (None, "")]) == []
    assert _got(spark, [("en", "a b. " * 10)]) == [("en", 1, "a b", 10, 10, 10, 20, 1_000_000)]


def test_sketch_never_counts_too_low(spark):
    import numpy as np

    words = C.Words("en", ["a b c a b c", "x\ty. z"])
    assert [words.phrase(i, n) for n, at, _, _ in words.grams(3) for i in at.tolist()] == ["a", "b", "c", "a", "b", "c", "x", "y", "z", "a b", "b c", "c a", "a b", "b c", "x y", "a b c", "b c a", "c a b", "a b c"]
    assert all(len(np.unique(g)) == n for (_, _, g, _), n in zip(words.grams(3), (6, 4, 3)))
