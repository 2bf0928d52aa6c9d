"""Counts of lines in the arrays of the perfect hashes, against a plain counter."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import line_dedup


def plain(texts, min_chars=1):
    out = Counter()
    for t in texts:
        out.update({k for k in line_dedup.line_keys(t) if len(k.decode()) >= min_chars})
    return out


def hashed(counts):
    h1, h2 = line_dedup._hashes(list(counts))
    return dict(zip(zip(h1.tolist(), h2.tolist()), counts.values()))


def some_texts():
    rng = np.random.default_rng(3)
    texts = ["\n".join(f" Line {int(x)}\t" for x in rng.zipf(1.3, 30) if x < 4000) for _ in range(400)]
    return [*texts, None, "", "\n\n", "hot\nhot\nHOT ", *["hot\n\u00e9"] * 200]


@pytest.mark.parametrize("most", [1, 7, 1 << 18])
def test_lines_add_up_before_the_shuffle(most):
    texts, got = some_texts(), Counter()
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    for b in line_dedup._emit(1, most)(iter([batch])):
        h1, h2 = line_dedup._unsigned(b, "h1", "h2")
        for a, c, n in zip(h1.tolist(), h2.tolist(), b.column("n").to_pylist()):
            got[a, c] += n
    assert got == hashed(plain(texts))


@pytest.mark.parametrize("min_docs", [1, 2, 10])
def test_a_shard_counts_every_line(min_docs):
    want = hashed(plain(some_texts()))
    rows = [(a, b, 1) for (a, b), n in want.items() for _ in range(n)]  # every line as often as it occurs, also those below the threshold
    h1, h2 = (np.array([r[i] for r in rows], np.uint64) for i in (0, 1))
    shard = line_dedup.LineIndex(h1, h2, np.ones(len(rows), np.int64))
    assert shard.hash.n == len(want) and sorted(shard.counts.tolist()) == sorted(want.values())
    assert shard.count(h1, h2).tolist() == [want[a, b] for a, b, _ in rows]
    got = line_dedup.count_shard(h1, h2, np.ones(len(rows), np.int64), min_docs)
    assert dict(zip(zip(got[0].tolist(), got[1].tolist()), got[2].tolist())) == {k: n for k, n in want.items() if n >= min_docs}


@pytest.mark.parametrize("shard_lines, rows_a_batch", [(1, 5), (50, 3), (50, 1000), (1 << 20, 64)])
def test_shards_are_cut_between_buckets(shard_lines, rows_a_batch):
    want = hashed(plain(some_texts()))
    rows = sorted(((a >> 60), a, b, n) for (a, b), total in want.items() for n in ([1] * (total - 1) + [1]))
    def batches():
        for at in range(0, len(rows), rows_a_batch):
            part = rows[at : at + rows_a_batch]
            h1, h2 = (np.array([r[i] for r in part], np.uint64).view(np.int64) for i in (1, 2))
            yield pa.record_batch([pa.array(h1), pa.array(h2), pa.array([r[3] for r in part], pa.int64()), pa.array([r[0] for r in part], pa.int64())], ["h1", "h2", "n", "bucket"])
            yield pa.record_batch([pa.array([], pa.int64())] * 4, ["h1", "h2", "n", "bucket"])
    got = [(a, b, n) for out in line_dedup._count(2, shard_lines)(batches()) for a, b, n in zip(*(x.tolist() for x in line_dedup._unsigned(out, "h1", "h2")), out.column("n").to_pylist())]
    assert len(got) == len(set(got)) and {(a, b): n for a, b, n in got} == {k: n for k, n in want.items() if n >= 2}


def test_index_equals_plain_counts(spark):
    texts = some_texts()
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    index, shards, lines = line_dedup.line_index(docs, 3, 1, shard_lines=20)
    often = {k: n for k, n in plain(texts).items() if n >= 3}
    assert lines == len(often) and index.count() <= shards
    found = {r["shard"]: line_dedup.pickle.loads(bytes(r["index"])) for r in index.collect()}
    for k, n in often.items():
        h1, h2 = line_dedup._hashes([k])
        assert found[int(line_dedup._shard(h1, shards)[0])].count(h1, h2).tolist() == [n]
