"""Hand-worked packing, batching and shard cases."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import samples, shards


def packed(spark, blocks, answer, window, **kw):
    df = spark.createDataFrame([([list(range(n)) for n in blocks], list(range(100, 100 + answer)))], "blocks array<array<int>>, answer array<int>")
    return samples.pack(df, window, **kw).first()


@pytest.mark.parametrize(
    "blocks, answer, window, kept, length, masked",
    [([4, 5, 3, 1], 3, 9, 2, 7, 4), ([1, 9, 1], 2, 9, 1, 3, 1), ([5, 4, 3, 2, 0, 1], 3, 9, 3, 9, 6), ([1], 9, 9, 0, 9, 0)])
def test_whole_turns(spark, blocks, answer, window, kept, length, masked):
    r = packed(spark, blocks, answer, window)
    assert (r["kept_blocks"], r["seq_len"], r["masked"], r["skipped"]) == (kept, length, masked, None)
    assert r["labels"] == [-100] * masked + list(range(100, 100 + answer))
    assert len(r["input_ids"]) == length


def test_skips_and_prompt_loss(spark):
    assert packed(spark, [1], 10, 9)["skipped"] == "answer"
    assert packed(spark, [10, 1], 2, 9)["skipped"] == "block"
    r = packed(spark, [2], 2, 9, prompt_loss=True)
    assert r["labels"] == r["input_ids"] and r["masked"] == 0
    with pytest.raises(ValueError):
        samples.pack(spark.range(1), 0)


def test_plain(spark):
    df = spark.createDataFrame([(1, "one"), (2, "  "), (3, "a b c d"), (4, None)], "k int, text string")
    got = {r["k"]: r["input_ids"] for r in samples.pack_plain(df, 3).collect()}
    assert list(got) == [1] and len(got[1]) == 2 and got[1][1] == X.EOS_ID


def test_signature(spark):
    df = spark.createDataFrame([([11, 22, 33, 7], [-100, -100, -100, 7]), ([1, 2], [1, 2])], "i array<int>, l array<int>")
    assert [r[0] for r in df.select(shards.signature(F.col("i"), F.col("l"))).collect()] == [830529663, 0]


def test_shards_partition_the_samples(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, [1] * n, [1] * n, n) for i, n in enumerate(rng.randrange(2, 60) for _ in range(1300))], "seq long, input_ids array<int>, labels array<int>, seq_len int")
    got = shards.buffered_order(df, 100).select("seq", "seq_len", "buffer", "global_idx", "shard_idx").collect()
    lengths = {r["seq"]: r["seq_len"] for r in got}
    want = [s for a in range(0, 1300, 512) for s in sorted(range(a, min(a + 512, 1300)), key=lambda s: (lengths[s], s))]
    assert [r["seq"] for r in sorted(got, key=lambda r: r["global_idx"])] == want
    assert all(r["shard_idx"] == r["global_idx"] // 100 for r in got)
    ordered = shards.buffered_order(df, 100)
    assert sorted(r["global_idx"] for k in range(4) for r in shards.of_rank(ordered, 2, k // 2, 2, k % 2).collect()) == list(range(1300))
    for shuffled in (shards.shuffled_exact(ordered, 0), shards.shuffled_hash(ordered, 1, 0)):
        rows = shuffled.collect()
        by = {}
        for r in rows:
            by.setdefault(r["shard_idx"], []).append(r["order_in_shard"])
        assert len(rows) == 1300 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_padding_and_buffers(spark):
    df = spark.createDataFrame([(0, [1] * 3, [1] * 3, 3), (1, [1] * 9, [1] * 9, 9)], "pos long, input_ids array<int>, labels array<int>, seq_len int")
    r = shards.batches(df, 2).orderBy("pos").collect()
    assert [len(x["input_ids"]) for x in r] == [16, 16] and r[0]["labels"][3:] == [-100] * 13 and sum(r[0]["attention_mask"]) == 3
    assert [shards.buffer_size(n) for n in (100, 5000, 50_000)] == [512, 10_000, 20_000]


def test_text(spark):
    df = spark.createDataFrame([("  7.0\n", "a\r\nb\x1cc\n", "x\t y　z "), (None, None, None)], "i string, l string, w string")
    rows = df.select(X.normalize_id(F.col("i")), X.lines(F.col("l")), X.words(F.col("w")), X.squeeze(F.col("w"))).collect()
    assert tuple(rows[0]) == ("7", ["a", "b", "c"], ["x", "y", "z"], "x y z")
    assert tuple(rows[1]) == ("", [], [], "")
    got = spark.range(1).select(X.phrase_token(F.lit("hello world")), X.format_eta(F.lit(3725)), X.occurrences(F.lit("aaaa aa"), F.lit("aa"))).first()
    assert tuple(got) == ("<|ng:2aae6c35c94fcfb4|>", "01:02:05", 3)
