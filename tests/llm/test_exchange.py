"""Certificates of partitions, and the exchange of bins with gaps between them."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import packing


def test_all_gaps_are_exchanged(spark):
    # lengths of 39 and 25 fill a window of 64 in pairs; a partition of 20,000 has chance surpluses of over 100 of one
    sizes = [38] * 50_000 + [24] * 50_000
    random.Random(3).shuffle(sizes)
    docs = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, k int").select("doc_id", F.repeat(F.lit("word "), F.col("k")).alias("text"))
    got = packing.pack_documents(docs, window=64).groupBy("sequence_id").agg(F.sum("length").alias("used"), F.count("*").alias("n")).toPandas()
    assert got.n.sum() == 100_000 and got.used.max() == 64
    assert len(got) == 50_000


def lengths_of(spark, sizes, **kw):
    docs = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, k int").select("doc_id", F.repeat(F.lit("word "), F.col("k")).alias("text"))
    return packing.pack_documents(docs, window=64, **kw)


def rounds(monkeypatch):
    """Numbers of pieces that each round packs, by round."""
    seen, plain = [], packing._packer

    def packer(window, keep_open, round_no):
        seen.append(round_no)
        return plain(window, keep_open, round_no)

    monkeypatch.setattr(packing, "_packer", packer)
    return seen


def test_certified_partitions_are_not_opened_again(spark, monkeypatch):
    seen = rounds(monkeypatch)
    got = lengths_of(spark, [40] * 900, group_pieces=100).toPandas()  # no two fit one window: every partition meets its bound at once, gaps and all
    assert seen == [0] and got.sequence_id.nunique() == 900 and (got.offset == 0).all()


def test_only_the_uncertified_exchange(spark, monkeypatch):
    """Thirds and a bit more: best-fit decreasing misses the bound of a partition only where its parts don't come out even."""
    seen = rounds(monkeypatch)
    rng = np.random.default_rng(5)
    sizes = rng.choice([15, 20, 24, 31, 42], 4000).tolist()
    got = lengths_of(spark, sizes, group_pieces=250).toPandas()
    bound, at_once = packing.lower_bound(np.bincount(got.length, minlength=65)), packing.best_fit_decreasing(got.length.to_numpy(), 64).max() + 1
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 64 and len(got) == 4000 and bound <= len(used) <= at_once + 1  # as good as one packing of all pieces
    first = got[got.sequence_id < 1 << 48]
    assert len(seen) > 1 and 0 < len(first) < 4000  # some partitions or bins stood from the first round on, the rest went on


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_whole_texts_of_any_tokenizer(spark, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    texts = ["It's 1,000  Words.\n\tDéjà vu -- THE <|endoftext|> end.", None, "", "a b " * 70, "日本語 ñ \x85 x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in packing.pack_documents(df, window=64, end_id=7, tokenizer_path=path).collect()}
    want = {}
    for i, t in enumerate(texts):
        raw = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 7], "<u4").tobytes()
        want |= {(i, k): zlib.crc32(raw[a : a + 256]) for k, a in enumerate(range(0, len(raw), 256))}
    assert got == want
