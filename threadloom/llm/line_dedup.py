"""Removal of lines that many documents share, through sharded minimal perfect hash arrays."""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm._batches import sliced
from threadloom.llm._store import forget, written
from threadloom.llm._words import mix

_U = np.uint64
_GAMMA = 2.0
#: Names of the first pass's counts while a later one adds its own.
_KEPT = ("__n_lines", "__n_dropped")


class PerfectHash:
    """Minimal perfect hash by levelled bit arrays: a key rests on the first level where it meets no other key.

    ``place`` gives a number below the number of keys, its own for every key of the set; other keys get any number
    or -1, so callers compare a fingerprint.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        left, base = np.unique(keys.astype(_U)), 0
        depth = 0
        while len(left):
            size = max(64, int(_GAMMA * len(left)) | 1)
            at = self._at(left, depth, size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)]).view(_U)
            ones = np.cumsum(np.bitwise_count(bits).astype(np.int64))
            self.levels.append((bits, np.concatenate([[0], ones[:-1]]).astype(np.uint32), size, base))
            base += int(ones[-1])
            left, depth = left[~alone[at]], depth + 1
        self.n = base

    @staticmethod
    def _at(keys: np.ndarray, depth: int, size: int) -> np.ndarray:
        return (mix(keys + _U((depth + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % _U(size)).astype(np.int64)

    def place(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for depth, (bits, ranks, size, base) in enumerate(self.levels):
            if not len(todo):
                break
            at = self._at(keys[todo], depth, size)
            word, bit = bits[at >> 6], (at & 63).astype(_U)
            hit = (word >> bit) & _U(1) == 1
            below = np.bitwise_count(word & ((_U(1) << bit) - _U(1))).astype(np.int64)
            out[todo[hit]] = (base + ranks[at >> 6] + below)[hit]
            todo = todo[~hit]
        return out


class LineIndex:
    """One shard: perfect hash over its distinct line hashes, with fingerprints and document counts in its order.

    Rows that repeat a line add up in the line's place of the count array.
    """

    def __init__(self, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray):
        # the key joins both hashes, so lines that share one of them stay apart
        key = _key(h1, h2)
        self.hash = PerfectHash(key)
        at = self.hash.place(key)
        self.prints, total = np.zeros(self.hash.n, _U), np.zeros(self.hash.n, np.int64)
        self.prints[at] = h2
        np.add.at(total, at, counts)
        self.counts = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Number of documents that hold each line; 0 for lines outside the index."""
        at = self.hash.place(_key(h1, h2))
        ok = at >= 0
        ok[ok] = self.prints[at[ok]] == h2[ok]
        out = np.zeros(len(h1), np.int64)
        out[ok] = self.counts[at[ok]]
        return out


def _key(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return mix(h1 ^ mix(h2))


def _shard(h1: np.ndarray, shards: int) -> np.ndarray:
    return (mix(h1 + _U(0x632BE59BD9B4E019)) % _U(shards)).astype(np.int64)


def line_keys(text: str | None) -> list[bytes]:
    """Key of each line: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [x.strip() for x in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each key."""
    return _halves([xxhash.xxh3_128_digest(k) for k in keys])


def _halves(digests) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(digests), ">u8").astype(_U).reshape(-1, 2)
    return raw[:, 0], raw[:, 1]


def _emit(min_chars: int, most: int = 1 << 18):
    """Arrow function: (h1, h2, n) of lines, rows that hold a line added up over up to ``most`` lines, so that a hot line is sent once for them."""

    def run(batches):
        held: Counter[bytes] = Counter()
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                held.update({xxhash.xxh3_128_digest(k) for k in set(line_keys(text)) if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode("utf-8", "surrogatepass")) >= min_chars)})
                if len(held) >= most:
                    yield _counted(*_halves(held), np.fromiter(held.values(), np.int64, len(held)))
                    held = Counter()
        if held:
            yield _counted(*_halves(held), np.fromiter(held.values(), np.int64, len(held)))
    return run


def _counted(h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n.astype(np.int64))], ["h1", "h2", "n"])


def _unsigned(batch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy().astype(np.int64).view(_U) for c in names]


def count_shard(h1: np.ndarray, h2: np.ndarray, n: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2, count) of a shard's lines that at least ``min_docs`` rows hold; all its lines are counted in the arrays of its perfect hash."""
    shard = LineIndex(h1, h2, n)
    first = np.zeros(shard.hash.n, _U)
    first[shard.hash.place(_key(h1, h2))] = h1
    often = shard.counts >= min_docs
    return first[often], shard.prints[often], shard.counts[often]


def _count(min_docs: int, shard_lines: int):
    """Arrow function over rows in the order of ``bucket``: cuts them into shards of whole buckets, at least ``shard_lines`` rows each but the last."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            bucket, cols = batch.column("bucket").to_numpy(), (*_unsigned(batch, "h1", "h2"), batch.column("n").to_numpy())
            ends = np.flatnonzero(np.diff(bucket)) + 1
            if held and len(bucket) and bucket[0] != last:
                ends = np.concatenate([[0], ends])
            at = 0
            for end in ends.tolist():
                if size + end - at >= shard_lines:
                    held.append([c[at:end] for c in cols])
                    yield _counted(*count_shard(*(np.concatenate(c) for c in zip(*held, strict=True)), min_docs))
                    held, size, at = [], 0, end
            if len(bucket):
                held.append([c[at:] for c in cols])
                size, last = size + len(bucket) - at, bucket[-1]
        if size:
            yield _counted(*count_shard(*(np.concatenate(c) for c in zip(*held, strict=True)), min_docs))
    return run


def _build(key, table):
    index = LineIndex(*_unsigned(table, "h1", "h2"), table.column("n").to_numpy())
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "index": pa.array([pickle.dumps(index, 5)], pa.binary())})


def line_index(docs: DataFrame, min_docs: int, min_chars: int, text: str = "text", shard_lines: int = 1 << 20) -> tuple[DataFrame, int, int]:
    """Index shards (``shard``, ``index``) of the lines that at least ``min_docs`` rows hold; number of shards; of lines.

    Line hashes go to partitions by hash and are sorted into 65,536 buckets there. A run of buckets is a shard: its task builds a
    perfect hash over all its distinct lines and adds up their documents in the count array; only what reaches ``min_docs`` leaves it.
    """
    seen = docs.select(F.col(text).alias("text")).mapInArrow(_emit(min_chars), "h1 long, h2 long, n long")
    sharded = seen.repartition("h1").withColumn("bucket", F.shiftrightunsigned("h1", 48)).sortWithinPartitions("bucket")
    often = written(sharded.mapInArrow(_count(min_docs, shard_lines), "h1 long, h2 long, n long"), "lines")
    lines = often.count()
    shards = max(1, -(-lines // shard_lines))
    placed = often.mapInArrow(_placer(shards), "h1 long, h2 long, n long, shard long")
    return written(placed.groupBy("shard").applyInArrow(_build, "shard long, index binary"), "index"), shards, lines


def _placer(shards: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_shard(b.column(0).to_numpy().astype(np.int64).view(_U), shards))], ["h1", "h2", "n", "shard"])
    return run


def _drop(text: str | None, often: np.ndarray, spot: int) -> tuple[list[str], int]:
    lines = (text or "").split("\n")
    gone = often[spot : spot + len(lines)]
    return [x for x, g in zip(lines, gone, strict=True) if not g] if gone.any() else lines, int(gone.sum())


def _apply(shared, shards: int, min_docs: int, where: int):
    """Arrow function: probes the arrays for the lines of column ``where`` and adds n_lines, n_dropped."""

    def run(batches):
        index: dict[int, LineIndex] = shared.value
        for batch in sliced(batches):
            texts = batch.column(where).to_pylist()
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < 1 << 21):
                    chars += len(texts[to] or "")
                    to += 1
                keys = [line_keys(t) for t in texts[at:to]]
                flat = [k for ks in keys for k in ks]
                h1, h2 = _hashes(flat)
                of = _shard(h1, shards)
                often = np.zeros(len(flat), bool)
                for s in np.unique(of):
                    if s in index:
                        mine = np.flatnonzero(of == s)
                        often[mine] = index[s].count(h1[mine], h2[mine]) >= min_docs
                kept, gone, spot = [], [], 0
                for t, ks in zip(texts[at:to], keys, strict=True):
                    lines, n = _drop(t, often, spot)
                    spot += len(ks)
                    kept.append("\n".join(lines))
                    gone.append(n)
                part = batch.slice(at, to - at)
                cols = [*part.columns]
                cols[where] = pa.array(kept, part.schema.field(where).type)
                yield pa.RecordBatch.from_arrays([*cols, pa.array([len(k) for k in keys], pa.int64()), pa.array(gone, pa.int64())], [*part.schema.names, "n_lines", "n_dropped"])
                at = to
    return run


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` without the lines that at least ``min_docs`` documents hold, plus ``n_lines`` and ``n_dropped``.

    A line ends at ``\\n``; its key is the line stripped of ASCII white space with A-Z lower-cased; keys of fewer
    than ``min_chars`` code points always stay. Every row is a document, repeated rows too, and a line counts once
    a row. Null text is one empty line and comes back empty; rows, order of lines and other columns stay; columns
    named like the two new ones are replaced. An empty table gives no row.

    The frequent lines' index is sent to the executors if it takes at most ``broadcast_bytes``; a larger one is
    sent in blocks of that size, one pass over the documents each. Every pass but the last is written before the next begins and
    only its block is sent, so no executor ever holds more than one block; a later pass sees what the earlier ones kept.
    """
    if min_chars < 1:
        raise ValueError("min_chars must be at least 1")
    docs = docs.drop("n_lines", "n_dropped")
    index, shards, lines = line_index(docs, min_docs, min_chars, text)
    blocks = max(1, -(-(lines * 24) // broadcast_bytes))
    spark, where = docs.sparkSession, docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    out = before = None
    for k in range(blocks):
        got = index.where(F.pmod("shard", F.lit(blocks)) == k) if blocks > 1 else index
        shared = spark.sparkContext.broadcast({r["shard"]: pickle.loads(bytes(r["index"])) for r in got.toLocalIterator()})
        if out is None:
            out = docs.mapInArrow(_apply(shared, shards, min_docs, where), schema)
        else:  # lines that an earlier block took are gone already
            again = out.withColumnsRenamed({"n_lines": _KEPT[0], "n_dropped": _KEPT[1]})
            wide = T.StructType([*again.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
            out = again.mapInArrow(_apply(shared, shards, min_docs, where), wide)
            out = out.select(*docs.columns, F.col(_KEPT[0]).alias("n_lines"), (F.col(_KEPT[1]) + F.col("n_dropped")).alias("n_dropped"))
        if k < blocks - 1:
            out = written(out, "pass")
            shared.unpersist()
            if before is not None:
                forget(before)
            before = out
    return out


def line_digest(cleaned: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of documents that went through ``drop_common_lines``."""
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
