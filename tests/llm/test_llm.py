"""Operators against brute force, exact round trips and edge cases: nulls, empty texts and tables, repeated rows, extra columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import chat_format, line_dedup, media, minhash, packing, piece_transducer, quality, toxicity, url_filter
from threadloom.llm import _words as W
from threadloom.llm._store import connected_components

DOC = "doc_id long, text string, n_lines string, score string, component string, key string, id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "k", "i") for i, t in rows], DOC)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_urls(spark):
    link = '<html><LINK href="{}" rel=canonical></html>'
    rows = [
        (1, "https://www.example.com/en/a", None), (2, "http://EXAMPLE.com/en/a?x", ""), (3, "http://x.example.net/es/1", "<p>"), (4, "http://b.org/p", link.format("http://x.example.net/es/1")),
        (5, "http://c.org/p", '<meta http-equiv="refresh" content="0; url=/p2">'), (6, "http://c.org/p2", link.format("//b.org/p")), (7, "http://d.org/", link.format("http://www.example.com/en/z")),
        (8, "http://d.org/x", link.format("http://d.org/")), (9, None, None), (10, "no scheme", None), (11, "http://www.notexample.com/en/", None), (11, "http://www.notexample.com/en/", None), (None, "http://com", None),
    ]
    got = [tuple(r) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "rule", "verdict", "verdict_source").collect()]
    want = [
        (1, "www.example.com/en/", "allow", "rule"), (2, "example.com/en/", "block", "rule"), (3, "net/es/", "block", "rule"), (4, None, "block", "alias"), (5, None, "block", "alias"), (6, None, "block", "alias"),
        (7, None, "allow", "alias"), (8, None, "allow", "alias"), (9, None, "allow", "default"), (10, None, "allow", "default"), (11, "com/", "allow", "rule"), (11, "com/", "allow", "rule"), (None, None, "allow", "default")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST] <~s> <|im_end|> [~~INST] <~|im_sep|> << <"
    rows = [(1, 0, "user", said), (1, 1, "user", "b"), (1, 2, "assistant", said), (1, 3, "assistant", None), (2, 0, None, "é"), (2, None, "assistant", "first"), (None, 1, "user", ""), (3, 0, "<s>", "x"), (3, 0, "<s>", "x")]
    df = spark.createDataFrame([(*r, "w") for r in rows], "conv_id long, turn int, role string, text string, formatted string")
    out = chat_format.format_conversations(df)
    got = {r["conv_id"]: r for r in out.select("*", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == c), key=key)
        assert [tuple(x) for x in got[c]["back"]] == [(r[2] or "", r[3] or "") for r in mine]
        assert got[c]["loss"] == [r[3] or "" for r in mine if r[2] == "assistant"]
    d = {r["conv_id"]: r for r in chat_format.digest(out).collect()}
    assert d[1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nuser\nb\nassistant\n\nassistant\n{said}\n".encode()).hexdigest() or d[1]["n_turns"] == 4
    assert d[1]["loss_chars"] == len(said)
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def brute_classes(rows, similarity=0.8):
    bags = {}
    for i, t in rows:
        w = (t or "").lower().split()
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    ids, parent = sorted(bags), {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b:
                inter = sum((bags[a] & bags[b]).values())
                if inter >= similarity * (sum(bags[a].values()) + sum(bags[b].values()) - inter) - 1e-9:
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(i, " ".join(w if rng.random() > rng.choice([0.005, 0.02, 0.04]) else rng.choice(words) for w in base)) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(30)]
    rows += [(200, rows[3][1].upper()), (201, rows[70][1]), (202, ""), (203, None), (204, "  \n"), (205, "a b"), (206, "a  b")]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs(spark, [*rows, rows[0]])).collect()}
    assert got == brute_classes(rows)
    assert minhash.near_duplicates(docs(spark, []).limit(0)).count() == 0


def test_blocks_of_a_large_bucket(spark):
    """Rows of one bucket, compared in blocks, give the classes of all pairs."""
    members = spark.range(90).select(F.lit(1).cast("long").alias("key"), "id")
    linked = lambda a, b: a % 7 == b % 7 and abs(a - b) <= 14
    verify = lambda pairs: pairs.where("a % 7 = b % 7 and abs(a - b) <= 14")
    payload = lambda ids: ids.select("id", F.col("id").cast("string").cast("binary").alias("data"))

    def within(key, data):
        ids = [int(d) for d in data]
        return lambda i, js: [j for j in js if linked(ids[i], ids[j])]

    links = minhash.link_buckets(members, verify, payload, within, block=16)
    got = {r["node"]: r["component"] for r in connected_components(links, "a", "b").collect()}
    assert got == {i: i % 7 for i in range(90)}


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    el = rng.integers(0, 2**63, 300).astype(np.uint64)
    wa, wb = rng.random(300) * 3, rng.random(300) * 3
    sig = minhash.dart_signatures(np.concatenate([el, el]), np.repeat([0, 1], 300), 3, 2000, np.concatenate([wa, wb]))
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05
    assert (sig[2] == np.uint64(2**64 - 1)).all()


def test_line_dedup(spark):
    rng = random.Random(7)
    pool = [" Common A ", "common a\t", "COMMON B", "éÉ", "", " ", "rare"]
    rows = [(i, "\n".join(rng.choice(pool[:-1]) if rng.random() < 0.6 else f"own {i} {k}" for k in range(rng.randrange(0, 6)))) for i in range(40)] + [(50, None), (51, ""), (52, "rare"), (50, None)]
    seen = Counter()
    key = lambda x: x.encode().lower().strip()
    for _, t in rows:
        seen.update({key(x) for x in (t or "").split("\n")})
    want = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not key(x) or seen[key(x)] < 10]
        want.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    for most in (64 << 20, 24):  # one broadcast, and several blocks
        out = line_dedup.drop_common_lines(docs(spark, rows), 10, 1, broadcast_bytes=most)
        assert sorted(tuple(r) for r in line_dedup.line_digest(out).collect()) == sorted(want)
    assert out.columns[-2:] == ["n_lines", "n_dropped"] and "score" in out.columns
    assert line_dedup.drop_common_lines(docs(spark, []).limit(0)).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**63, 20_000).astype(np.uint64))
    h = line_dedup.PerfectHash(keys)
    assert h.n == len(keys) and sorted(h.place(keys)) == list(range(len(keys)))
    index = line_dedup.LineIndex(keys, keys + np.uint64(1), np.arange(len(keys)) + 10)
    assert (index.count(keys, keys + np.uint64(1)) == np.arange(len(keys)) + 10).all()
    assert (index.count(keys + np.uint64(5), keys) == 0).all()


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    alphabet = "ab'sStd ré.,,..<|endoftext|>ÀßÉ日ªµ́क़İΣς1２\x1c\x85 \t\n\r-—🙂THE the. "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [None, "", "It's <|endoftext|>. x.y, The THE, ça"]
    for t, raw in zip(texts, packing.encode_texts(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_packing(spark):
    rng = random.Random(8)
    rows = [(i, "word " * rng.randrange(0, 90)) for i in range(300)] + [(400, None), (401, ""), (402, "x " * 1000), (None, "a"), (402, "x " * 1000)]
    got = packing.pack_documents(docs(spark, rows), window=64, group_pieces=60, keep_open=4).toPandas()
    want = Counter((i, k, zlib.crc32(part)) for (i, _), raw in zip(rows, packing.encode_texts([t for _, t in rows]), strict=True) for k, part in enumerate(_cut(raw + b"\1\0\0\0", 256)))
    assert Counter((None if i != i else int(i), k, c) for i, k, c in zip(got.doc_id, got.piece, got.ids_crc32, strict=True)) == want
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 64
    bound = packing.lower_bound(np.bincount(got.length, minlength=65))
    assert bound <= got.sequence_id.nunique() <= 1.03 * bound + 1
    assert packing.pack_documents(docs(spark, []).limit(0)).count() == 0


def _cut(raw, n):
    return [raw[a : a + n] for a in range(0, len(raw), n)]


def test_bounds_never_exceed_the_optimum():
    rng = np.random.default_rng(4)
    for _ in range(200):
        lengths = rng.integers(1, 21, rng.integers(1, 9))
        bound = packing.lower_bound(np.bincount(lengths, minlength=21))
        assert bound <= _optimum(sorted(lengths.tolist(), reverse=True), 20) <= packing.best_fit_decreasing(lengths, 20).max() + 1


def _optimum(items, window):
    best = len(items)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= window:
                put(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        put(k + 1, [*bins, items[k]])

    put(0, [])
    return best


def test_pieces_equal_the_library():
    import public_tokenizers
    import sentencepiece

    lib, fst = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), piece_transducer.transducer()
    rng = random.Random(3)
    alphabet = "ab  \n\t▁éß日本🙂<s></s><0x41>'’aaaaaeeeiiittthhh..--==00011́\x00"
    for _ in range(1500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert fst.encode(t).tolist() == lib.encode(t), repr(t)
        ids = [rng.randrange(400) for _ in range(8)]
        assert fst.decode(np.array(ids)) == lib.decode(ids)
    assert fst.encode(None).tolist() == [] and fst.decode(np.array([], int)) == ""


def test_unigram_path_is_the_shortest():
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    pieces = {"▁": -2.0, "a": -1.5, "b": -1.7, "ab": -2.5, "▁a": -2.2, "ba": -2.9, "▁ab": -5.0}
    data = field(1, field(1, b"<unk>") + b"\x18\x02") + b"".join(field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes()) for p, s in pieces.items())
    fst = piece_transducer.PieceTransducer(data + field(2, b"\x18\x01") + field(3, b"\x18\x01\x20\x00\x28\x01"))

    def best(s):
        return 0.0 if not s else max((sc + best(s[len(p) :]) for p, sc in pieces.items() if s.startswith(p)), default=-1e9)

    for t in ("ab", "abab", "ba ab", "a b a", "bbaba"):
        ids = fst.encode(t).tolist()
        assert abs(sum(pieces[fst.pieces[i]] for i in ids) - best("▁" + t.replace(" ", "▁"))) < 1e-5
        assert fst.decode(np.array(ids)) == t
    assert fst.encode("ac").tolist()[-1] == 0


def _texture(rng, n=128):
    return media._smooth(media._resize(rng.random((16, 16)) * 255, n, n))


def _pgm(img):
    return b"P5 %d %d 255\n" % (img.shape[1], img.shape[0]) + np.clip(np.rint(img), 0, 255).astype(np.uint8).tobytes()


def _png(img):
    def chunk(kind, data):
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    a = np.clip(np.rint(img), 0, 255).astype(np.uint8)
    h, w = a.shape
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    up = np.vstack([a[:1], a[1:] - a[:-1]])
    raw = b"".join(bytes([2 if y else 0]) + up[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_copies(spark):
    rng = np.random.default_rng(9)
    a, b, c = _texture(rng), _texture(rng), _texture(rng)
    rows = [(1, _pgm(a)), (2, _png(a)), (3, _pgm(a[15:115, 10:110])), (4, _pgm(a * 0.8 + 20)), (5, _pgm(np.rot90(a))), (6, _pgm(a + rng.normal(0, 3, a.shape))), (10, _pgm(b)), (11, _pgm(b)), (20, _pgm(c)), (30, None), (31, b"junk"), (32, b""), (33, _pgm(np.zeros((40, 40))))]
    df = spark.createDataFrame([(i, bytearray(x) if x is not None else None, "x") for i, x in rows], "image_id long, image binary, class_id string")
    got = {r["image_id"]: r["class_id"] for r in media.image_copies(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 10: 10, 11: 10, 20: 20, 30: 30, 31: 31, 32: 32, 33: 33}
    assert media.image_copies(df.limit(0)).count() == 0


LABELLED = "doc_id long, quality int, toxic int"


def _corpus(rng, n):
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        toxic, good = rng.random() < 0.25, rng.random() > 0.3
        if toxic:
            for w in ("nastyword", "vilething"):
                text.insert(rng.randrange(len(text)), w)
        if not good:
            text = [w + "$$$" for w in text] if i % 2 else [w for w in text[:6] for _ in range(15)]
        rows.append((i, " ".join(text)))
        labels.append((i, int(good), int(toxic and (good or i % 2))))
    return rows, labels


def test_classifiers(spark):
    rows, labels = _corpus(random.Random(10), 400)
    rows += [(1000, None), (1001, ""), (0, rows[0][1])]
    df, lab = docs(spark, rows).withColumn("accepted", F.lit("?")), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], LABELLED)
    truth = {i: (q, t) for i, q, t in labels}
    net = toxicity.fit(df, lab)
    scored = toxicity.score_documents(df, net).select("doc_id", "score", "predicted", "n_lines", toxicity.held_out(F.col("doc_id")).alias("held_out")).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scored)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored)
    held = [r for r in scored if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]][1] for r in held) >= 0.9 * len(held)
    model = quality.fit(df, lab)
    good = quality.score_documents(df, model).select("doc_id", "accepted").collect()
    assert len(good) == len(rows)
    known = [r for r in good if r["doc_id"] in truth]
    assert sum(r["accepted"] == bool(truth[r["doc_id"]][0]) for r in known) >= 0.97 * len(known)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)]])
def test_classifiers_without_two_classes(spark, labels):
    df, lab = docs(spark, [(1, "a b"), (2, None)]), spark.createDataFrame(labels, LABELLED)
    assert {r["predicted"] for r in toxicity.score_documents(df, toxicity.fit(df, lab)).collect()} == {0}
    assert {r["accepted"] for r in quality.score_documents(df, quality.fit(df, lab)).collect()} == {True}
    assert toxicity.score_documents(df.limit(0), toxicity.fit(df.limit(0), lab)).count() == 0


def test_word_hashes():
    texts = ["a bb ccc", "", None, "x" * 3000]
    words, counts, pre = W.word_hashes(texts, prefixes=(2,))
    assert counts.tolist() == [3, 0, 0, 1] and len(words) == len(pre) == 4
    many = ["w%d" % i for i in range(400_000)]
    assert (W.word_hashes([" ".join(many)])[0][-3:] == W.word_hashes([" ".join(many[-3:])])[0]).all()
