"""Document fingerprints: SimHash of whole texts, and permuted block tables that find all fingerprints within a radius."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm import _words as W
from threadloom.llm._batches import sliced
from threadloom.llm._store import connected_components, written
from threadloom.llm.minhash import link_buckets

_U = np.uint64
BITS = 256
#: Terms are single words and runs of three words.
_TERMS = (1, 3)
_HASH_BITS = 44
_MASK = _U((1 << _HASH_BITS) - 1)
_ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_WALKED = f"part int, role string, {_ROWS}, text string"


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Fingerprint of each text: array (n, 32) of bytes, all zero for a text without words.

    Terms are the words (lower-cased, divided at white space) and the runs of three of them. A term that stands t times
    weighs 16 (1 + ln t), rounded, and votes with that weight for or against each bit as its hash says; a bit is set if
    more weight is for it than against. Weights are whole numbers, so equal texts have equal fingerprints wherever they are computed.
    """
    votes = np.zeros((len(texts), BITS), np.int64)
    words, counts = W.word_hashes(texts)
    keys = []
    for n in _TERMS:
        runs, many = W.shingles(words, counts, n)
        keys.append(np.repeat(np.arange(len(texts), dtype=_U) << _U(_HASH_BITS), many) | (W.mix(runs + _U(n)) >> _U(64 - _HASH_BITS)))
    keys = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    weight = np.rint(16 * (1 + np.log(np.diff(first, append=len(keys))))).astype(np.float32)
    doc, term = (keys[first] >> _U(_HASH_BITS)).astype(np.int64), keys[first] & _MASK
    seeds = [_U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for j in range(BITS // 64)]
    for a in range(0, len(term), 1 << 10):  # sums of a block stay below 2**24 and so are exact in any order
        t, w, d = term[a : a + (1 << 10)], weight[a : a + (1 << 10)], doc[a : a + (1 << 10)]
        bits = np.unpackbits(np.stack([W.mix(t + s) for s in seeds], 1).view(np.uint8), axis=1).astype(np.float32)
        at = np.flatnonzero(np.diff(d, prepend=-1))
        for x, y in zip(at, [*at[1:], len(d)], strict=True):
            votes[d[x]] += np.rint(2 * (w[x:y] @ bits[x:y]) - w[x:y].sum()).astype(np.int64)
    return np.packbits(votes > 0, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of bits that two fingerprints have in common."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def edited(text: str, following: str) -> str:
    """``text`` with its last half of code points replaced by as many (or all) from the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _digest(ids: list[int | None], texts: list[str], following: list[str]) -> pa.RecordBatch:
    """Result rows of texts, each with the one that follows it."""
    changed = [edited(t, n) for t, n in zip(texts, following, strict=True)]
    own, nxt, new = np.split(fingerprints([*texts, *following, *changed]), 3) if texts[1:] != following[:-1] else _shifted(texts, following, changed)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed]),
        pa.array([x.tobytes().hex() for x in own]), pa.array([x.tobytes().hex() for x in new]), pa.array(likeness(own, new)), pa.array(likeness(own, nxt))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _shifted(texts: list[str], following: list[str], changed: list[str]):
    """Fingerprints where each text is the follower of the one before it: only the last follower is another text."""
    every = fingerprints([*texts, *following[-1:], *changed])
    n = len(texts)
    return every[:n], every[1 : n + 1], every[n + 1 :]


def _spans(texts: list[str], most: int = 1 << 20):
    at, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t) + 1
        if chars >= most:
            yield at, i + 1
            at, chars = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _walker():
    """Arrow function over a sorted partition: digests of every text but the last, whose follower lies elsewhere; the first and last text themselves."""

    def edge(role: str, doc_id, text: str) -> pa.RecordBatch:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        return _complete(pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([role]), pa.array([doc_id], pa.int64()), pa.array([text])], ["part", "role", "doc_id", "text"]))

    def run(batches):
        held = None
        for batch in sliced(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if held is None and ids:
                yield edge("head", ids[0], texts[0])
            elif ids:
                ids, texts = [held[0], *ids], [held[1], *texts]
            for a, b in _spans(texts[:-1]):
                yield _complete(_digest(ids[a:b], texts[a:b], texts[a + 1 : b + 1]))
            if ids:
                held = ids[-1], texts[-1]
        if held is not None:
            yield edge("tail", *held)
    return run


def _complete(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with all columns of a walk, null where it has none."""
    kinds = {"part": pa.int32(), "role": pa.string(), "doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
    names = [f.split()[0] for f in _WALKED.split(", ")]
    have = dict(zip(batch.schema.names, batch.columns, strict=True))
    return pa.RecordBatch.from_arrays([have[c] if c in have else pa.nulls(batch.num_rows, kinds.get(c, pa.string())) for c in names], names)


def _pairwise(batches):
    for batch in sliced(batches):
        ids, texts, following = (batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text"))
        for a, b in _spans([x + y for x, y in zip(texts, following, strict=True)]):
            yield _digest(ids[a:b], texts[a:b], following[a:b])


def digest_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every whole text and of its edited text, whose last half comes from the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``; the next document is that of the next
    smaller id, and the first one again after the last. Null text is empty; of rows that share an id the order is
    that of a hash of their texts, rows without an id come last. A single document follows itself. An empty table gives no row;
    other columns are ignored.

    Rows move once: they are dealt out in ranges of the order and each task walks its range. Only the
    first and last text of each range meet afterwards, by the number of their range.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]  # the last one divides repeated rows
    keyed = rows.select("*", *[c.alias(f"_{i}") for i, c in enumerate(order[1:])])
    keys = [order[0], F.col("_0"), F.col("_1")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    walked = written(ranged.mapInArrow(_walker(), _WALKED), "walk")
    inner = walked.where("role is null").select(*[f.split()[0] for f in _ROWS.split(", ")])
    heads, tails = (walked.where(F.col("role") == r).select("part", "doc_id", "text") for r in ("head", "tail"))
    # a row a range; the last one is followed by the first
    nxt = heads.select("part", F.lead("part").over(Window.orderBy("part")).alias("later"), F.min("part").over(Window.partitionBy()).alias("least"))
    nxt = nxt.select("part", F.coalesce("later", "least").alias("at"))
    edges = tails.join(nxt, "part").join(heads.select(F.col("part").alias("at"), F.col("text").alias("next_text")), "at")
    return inner.unionByName(edges.select("doc_id", "text", "next_text").mapInArrow(_pairwise, _ROWS))


def _words_of(c: Column) -> list[Column]:
    """The four 64-bit parts of a fingerprint in hex."""
    part = lambda i: F.conv(F.substring(c, 1 + 8 * i, 8), 16, 10).cast("long")
    return [F.shiftleft(part(2 * i), 32).bitwiseOR(part(2 * i + 1)) for i in range(BITS // 64)]


def distance(a: list[Column], b: list[Column]) -> Column:
    """Hamming distance of two fingerprints in four longs each."""
    out = F.lit(0)
    for x, y in zip(a, b, strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def block_spans(radius: int, pick: int = 1) -> list[tuple[int, int]]:
    """``radius + pick`` blocks that cover all bits: of fingerprints within the radius at least ``pick`` blocks agree."""
    n = radius + pick
    if not 0 <= radius < BITS or pick < 1 or n > BITS:
        raise ValueError("radius and blocks must fit the fingerprint")
    cuts = [BITS * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _tables(radius: int, pick: int):
    """Arrow function: a row for each permuted table of a fingerprint, keyed by the blocks that the permutation puts in front."""
    from itertools import combinations

    spans = block_spans(radius, pick)
    fronts = [np.concatenate([np.arange(*spans[i]) for i in c]) for c in combinations(range(len(spans)), pick)]

    def run(batches):
        for batch in batches:
            raw = np.frombuffer(bytes.fromhex("".join(batch.column("fingerprint").to_pylist())), np.uint8).reshape(-1, BITS // 8)
            bits, keys = np.unpackbits(raw, axis=1), []
            for t, front in enumerate(fronts):
                packed = np.packbits(bits[:, front], axis=1)
                packed = np.concatenate([packed, np.zeros((len(raw), -packed.shape[1] % 8), np.uint8)], axis=1).view(_U)
                key = np.full(len(raw), _U((t + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
                for c in packed.T:
                    key = W.mix(key ^ c)
                keys.append(key.astype(np.int64))
            keys = np.stack(keys, 1) if len(raw) else np.zeros((0, len(fronts)), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, len(fronts), dtype=np.int32), keys.ravel())], ["id", "keys"])
    return run


def _within(radius: int):
    def prepare(key: int, data: list[str]):
        prints = np.frombuffer(bytes.fromhex("".join(data)), np.uint8).reshape(-1, BITS // 8).view(_U)

        def linked_to(i: int, js: np.ndarray) -> np.ndarray:
            return js[np.bitwise_count(prints[js] ^ prints[i]).sum(axis=1) <= radius]
        return linked_to
    return prepare


def near_classes(prints: DataFrame, radius: int = 7, pick: int = 1, doc_id: str = "doc_id", fingerprint: str = "fingerprint") -> DataFrame:
    """``doc_id, fingerprint, class_id`` of every row: the smallest id among rows that fingerprints within ``radius`` bits join, directly or in steps.

    The bits are cut into ``radius + pick`` blocks; each choice of ``pick`` blocks is a table keyed by them, so two
    fingerprints within the radius share a key of at least one table, and every pair that shares a key is compared or
    known as one class already. Equal fingerprints are one from the start. A larger ``pick`` gives more tables with longer keys. Rows without a fingerprint have a null
    class; the class of rows without an id alone is null. An empty table gives no row.
    """
    rows = prints.select(F.col(doc_id).alias("doc_id"), F.col(fingerprint).alias("fingerprint"))
    same = rows.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))
    same = written(same.withColumn("id", F.monotonically_increasing_id()), "prints")
    members = same.select("id", "fingerprint").mapInArrow(_tables(radius, pick), "id long, keys array<long>").select("id", F.explode("keys").alias("key"))

    def verify(pairs: DataFrame) -> DataFrame:
        own = lambda c: same.select(F.col("id").alias(c), *[x.alias(f"{c}{i}") for i, x in enumerate(_words_of(F.col("fingerprint")))])
        got = pairs.join(own("a"), "a").join(own("b"), "b")
        return got.where(distance([F.col(f"a{i}") for i in range(4)], [F.col(f"b{i}") for i in range(4)]) <= radius).select("a", "b")

    links = link_buckets(members, verify, lambda ids: same.join(ids, "id").select("id", F.col("fingerprint").alias("data")), _within(radius))
    classes = connected_components(links, "a", "b")
    named = same.join(classes, F.col("id") == F.col("node"), "left").select("fingerprint", "rep", F.coalesce("component", "id").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    by_print = named.select("fingerprint", "label").join(least, "label").select("fingerprint", "class_id")
    return rows.join(by_print, "fingerprint", "left").select("doc_id", "fingerprint", "class_id")


def fingerprint_documents(docs: DataFrame, radius: int = 7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``digest_documents`` and the class of each document by ``near_classes``, as ``class_id``."""
    got = written(digest_documents(docs, doc_id, text), "digests")
    classes = near_classes(got, radius).select("fingerprint", "class_id").distinct()  # a row a fingerprint
    return got.join(classes, "fingerprint")
