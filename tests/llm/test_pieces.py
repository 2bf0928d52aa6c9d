"""The composed machines against the library, brute force and round trips; tables with nulls, repeats and no rows."""

import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from threadloom.llm import piece_transducer as P

SCHEMA = "doc_id long, text string, ids string, decoded string, n_ids int"


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def texts():
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlucmfwypvbgkqjxzéüßñ") for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    out += ["x" * 3000, "ab" * 2500 + " " + "日本語" * 500, "\t\n  a  \r\n", "▁▁a▁ b", "🙂" * 50, "  lead", "trail  ", "\x00\x01", "Á", "1234567890" * 30, "def f(x):\n    return x**2  # y"]
    return out


def test_whole_documents_equal_the_library(lib):
    fst, every = P.PieceTransducer(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()), texts()
    for _ in range(2):  # the second time from memory
        got = fst.encode_many(every)
        assert [g.tolist() for g in got] == [lib.encode(t) for t in every]
    assert [fst.decode(g) for g in got] == [lib.decode(lib.encode(t)) for t in every]


@pytest.mark.parametrize("remove, prefix", [(False, True), (True, True), (True, False), (False, False)])
def test_normaliser(remove, prefix):
    rng, machine = random.Random(4), P.Normaliser(prefix, remove)
    for _ in range(400):
        t = "".join(rng.choice("ab  é") for _ in range(rng.randrange(9)))
        s = re.sub(" +", " ", t.strip(" ")) if remove else t
        assert machine(t) == (((" " if prefix else "") + s) if s else "").replace(" ", "▁"), repr(t)


def model(pieces, kind, extra=b""):
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    head = field(1, field(1, b"<unk>") + b"\x18\x02") + b"".join(field(1, field(1, f"<0x{b:02X}>".encode()) + b"\x18\x06") for b in range(256))
    return P.PieceTransducer(head + b"".join(field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes()) for p, s in pieces) + field(2, bytes([0x18, kind])) + field(3, b"\x18\x00\x20\x00\x28\x01") + extra)


def merged(s, pieces):
    scores, parts = dict(pieces), list(s)
    while True:
        best = max(((scores[parts[k] + parts[k + 1]], -k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in scores), default=None)
        if best is None:
            return parts
        k = -best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_small_merging_models_with_equal_scores():
    rng = random.Random(5)
    for _ in range(60):
        pieces, have = [], ["a", "b", "c"]
        for step in range(10):  # parts come before what they merge to; some scores are shared, and c alone may be no piece
            new = rng.choice(have) + rng.choice(have)
            if new not in have and len(new) < 7:
                have.append(new)
                pieces.append((new, -float(step - step % 2)))
        pieces += [("a", -100.0), ("b", -100.0)] + [("c", -100.0)] * rng.randrange(2)
        fst = model(pieces, 2)
        for _ in range(25):
            s = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))
            want = [i for x in merged(s, pieces) for i in ([fst.ids[x]] if x in fst.ids else [fst.bytes[v] for v in x.encode()])]
            assert fst.encode(s).tolist() == want, (s, pieces)


def test_unigram_paths_are_shortest():
    rng = random.Random(6)
    for _ in range(30):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): -rng.random() * 6 for _ in range(12)}
        fst = model(list(pieces.items()), 1)
        floor = min(np.float32(v) for v in pieces.values()) - 10
        for _ in range(20):
            s = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 10)))
            best = [0.0] + [-np.inf] * len(s)
            for j in range(1, len(s) + 1):
                for i in range(j):
                    w = float(np.float32(pieces[s[i:j]])) if s[i:j] in pieces else floor if j == i + 1 else -np.inf
                    best[j] = max(best[j], best[i] + w)
            ids = fst.encode(s).tolist()
            got = sum(fst.scores[i] if fst.kinds[i] == 1 else floor for i in ids)
            assert abs(got - best[-1]) < 1e-4 and fst.decode(np.array(ids)) == s


def test_tables(spark, lib):
    every = texts()[:8]
    rows = [(i, t) for i, t in enumerate(every)] + [(3, every[3]), (100, None), (101, ""), (None, "a b"), (102, " ")]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)
    got = sorted((str(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in P.encode_documents(df).collect())
    assert got == sorted((str(i), lib.encode(t or ""), t or "") for i, t in rows)
    digest = {r["doc_id"]: tuple(r)[1:] for r in P.digest_documents(df).collect()}
    for i, t in rows:
        ids = np.array(lib.encode(t or ""), "<u4")
        assert digest[i] == (len(ids), zlib.crc32(ids.tobytes()), True)
    for f in (P.encode_documents, P.digest_documents):
        assert f(df.limit(0)).count() == 0 and f(df.where(F.lit(False))).count() == 0
