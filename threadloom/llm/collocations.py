"""Phrase collocations: merged count-min sketches prune n-grams, the rest is counted exactly, scored by cuts and subsumed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm import _words as W
from threadloom.llm._batches import sliced
from threadloom.llm._store import written

_U = np.uint64
#: What ends a piece, and what stands between words.
_ENDS, _GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_OUTSIDE, _ENDING = np.zeros(256, bool), np.zeros(256, np.int32)
_OUTSIDE[list(_ENDS + _GAPS)] = True
_ENDING[list(_ENDS)] = 1
#: Lang of rows that name none.
UNKNOWN = "und"
_ROWS, _SLICE = 2, 20
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPAN = 1 << 20
_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_known.get(base, ())) < n:
        a = np.full(max(n, _SPAN + 1), _U(base))
        a[0] = 1
        _known[base] = np.multiply.accumulate(a)
    return _known[base][:n]


class Words:
    """Words of texts of one language, A-Z lower-cased: their bytes, the piece of each and two 64-bit hashes."""

    def __init__(self, lang: str, texts: list[str]):
        self.lang, self.data = lang, ("\n".join(texts) + "\n").encode("utf-8", "surrogatepass").lower()
        raw = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(raw) + 1, bool)
        np.logical_not(_OUTSIDE[raw], out=inside[1:])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]  # the data ends outside words
        self.piece = np.cumsum(_ENDING[raw], dtype=np.int64)[self.start]
        salt = hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        self.hashes = [W.mix(h ^ _U(int.from_bytes(salt, "little"))) for h in self._plain(raw)]

    def _plain(self, raw: np.ndarray) -> list[np.ndarray]:
        """Polynomials of each word's bytes in two bases, by spans of about a megabyte that divide no word."""
        out, i = [np.empty(len(self.start), _U) for _ in _BASES], 0
        while i < len(self.start):
            at = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, at + _SPAN, side="right")))
            part = raw[at : self.end[j - 1]].astype(_U) + _U(1)
            s, e = self.start[i:j] - at, self.end[i:j] - at
            for h, base in zip(out, _BASES, strict=True):
                c = np.empty(len(part) + 1, _U)
                c[0] = 0
                np.cumsum(part * _powers(base, len(part)), out=c[1:])
                h[i:j] = (c[e] - c[s]) * _powers(pow(base, -1, 1 << 64), len(part) + 1)[s] + (e - s).astype(_U)
            i = j
        return out

    def grams(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each number of words up to ``most``: the first word and two hashes of every phrase that lies within a piece."""
        g1, g2 = self.hashes
        yield 1, np.arange(len(g1)), g1, g2
        for n in range(2, most + 1):
            g1, g2 = (W.mix(g[:-1] * _U(_BASES[0]) + h[n - 1 :]) for g, h in ((g1, self.hashes[0]), (g2, self.hashes[1])))
            at = np.flatnonzero(self.piece[: len(g1)] == self.piece[n - 1 :])
            yield n, at, g1[at], g2[at]

    def phrase(self, first: int, n: int) -> str:
        return b" ".join(self.data[self.start[first] : self.end[first + n - 1]].split()).decode("utf-8", "surrogatepass")


def _by_lang(batches, most: int = 1 << 22) -> Iterator[Words]:
    """Words of the texts of each language, by about ``most`` characters."""
    held: dict[str, list[str]] = {}
    chars = 0
    for batch in sliced(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            chars += len(text) + 1
            if chars >= most:
                yield from (Words(k, v) for k, v in held.items())
                held, chars = {}, 0
    yield from (Words(k, v) for k, v in held.items())


def _cells(g: np.ndarray, log: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each hash in the two rows of a sketch of ``2**log`` cells: its high and its low bits."""
    return (g >> _U(64 - log)).astype(np.uint32), (g & _U((1 << log) - 1)).astype(np.uint32)


def _packed(cells: np.ndarray) -> bytes:
    return pa.compress(cells.tobytes(), "zstd", asbytes=True)


def _sketcher(words: int, log: int, top: int):
    """Arrow function: the sketch of all n-grams of a task, cut into slices. A cell counts up to ``top``, which is all that the threshold asks for."""
    size, width = 1 << log, 1 << min(log, _SLICE)

    def run(batches):
        from pyspark import TaskContext

        rows = []
        for w in _by_lang(batches):
            rows = rows or [np.zeros(size, _kind(top)) for _ in range(_ROWS)]
            for _, _, g, _ in w.grams(words):
                for row, cells in zip(rows, _cells(g, log), strict=True):
                    cells.sort()
                    first = np.flatnonzero(np.diff(cells, prepend=~cells[:1]))
                    at = cells[first]
                    row[at] = np.minimum(row[at] + np.diff(first, append=len(cells)), top)
        source = TaskContext.get().partitionId()
        for r, row in enumerate(rows):
            for s in range(size // width):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([s], pa.int32()), pa.array([_packed(row[s * width : (s + 1) * width])], pa.binary()), pa.array([source], pa.int64())], _SKETCH)
    return run


_SKETCH = ["row", "slice", "cells", "source"]


def _kind(top: int):
    return np.uint8 if top < 1 << 8 else np.uint32


def _merge(log: int, top: int):
    """Grouped function: sums the same slice of several sketches."""
    width = 1 << min(log, _SLICE)

    def run(key, table):
        total = np.zeros(width, np.uint32)
        for cells in table.column("cells"):
            total = np.minimum(total + np.frombuffer(pa.decompress(cells.as_buffer(), width * _kind(top)().itemsize, "zstd"), _kind(top)), top).astype(np.uint32)
        row, piece, source = (k.as_py() for k in key)
        return pa.table({"row": pa.array([row], pa.int32()), "slice": pa.array([piece], pa.int32()), "cells": pa.array([_packed(total.astype(_kind(top)))], pa.binary()), "source": pa.array([source], pa.int64())})
    return run


def merged_sketch(parts: DataFrame, log: int, top: int, sources: int, fan: int = 64) -> DataFrame:
    """``row, slice, cells, source`` of the sum of all sketches; no task sums more than about ``fan`` slices at a time."""
    got, groups = parts, max(1, sources)
    while True:
        groups = -(-groups // fan)
        got = got.withColumn("source", F.pmod(F.xxhash64("source"), F.lit(groups)).cast("long")).groupBy("row", "slice", "source").applyInArrow(_merge(log, top), "row int, slice int, cells binary, source long")
        if groups == 1:
            return got


def _survivors(shared, words: int, log: int):
    """Arrow function: exact counts, by runs of texts, of the n-grams whose cells all reach the threshold."""

    def run(batches):
        bits = shared.value
        for w in _by_lang(batches):
            yield pa.RecordBatch.from_arrays([pa.array([w.lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([len(w.start)], pa.int64())], ["lang", "k", "phrase", "f"])
            for n, at, g, g2 in w.grams(words):
                ok = np.ones(len(g), bool)
                for often, cell in zip(bits, _cells(g, log), strict=True):
                    ok &= often[cell >> np.uint32(3)] >> (cell & np.uint32(7)).astype(np.uint8) & 1 == 1
                at, g, g2 = at[ok], g[ok], g2[ok]
                order = np.argsort(g, kind="stable")
                same = (g[order][1:] == g[order][:-1])
                if (same & (g2[order][1:] != g2[order][:-1])).any():  # two phrases of one hash: tell them apart by the other
                    order = np.lexsort((g2, g))
                    same = (g[order][1:] == g[order][:-1]) & (g2[order][1:] == g2[order][:-1])
                first = np.flatnonzero(np.concatenate([[True], ~same])) if len(g) else np.empty(0, np.int64)
                count = np.diff(first, append=len(g))
                for a in range(0, len(first), 1 << 16):
                    b = min(a + (1 << 16), len(first))
                    phrases = [w.phrase(i, n) for i in at[order[first[a:b]]].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([w.lang] * (b - a)), pa.array(np.full(b - a, n, np.int32)), pa.array(phrases), pa.array(count[a:b], pa.int64())], ["lang", "k", "phrase", "f"])
    return run


def phrase_counts(texts: DataFrame, words: int, min_count: int, log: int = 26) -> DataFrame:
    """Exact counts ``lang, k, phrase, f`` of all phrases of 1 to ``words`` words that occur ``min_count`` times or more; ``k`` 0 has a language's number of words.

    A count-min sketch counts every n-gram too high or right, so what it puts below the threshold is rare for certain, and only the rest
    is counted. It has two rows of ``2**log`` cells, whatever the size of the texts; as a bit for each cell (16 MB in all) it goes to
    every executor. A fuller sketch lets more rare phrases through to the exact count and loses none.
    """
    top = max(1, min_count)
    sketches = texts.mapInArrow(_sketcher(words, log, top), "row int, slice int, cells binary, source long")
    merged = merged_sketch(sketches, log, top, texts.rdd.getNumPartitions())
    width, bits = 1 << min(log, _SLICE), [np.zeros(-(-(1 << log) // 8), np.uint8) for _ in range(_ROWS)]
    thin = merged.select("row", "slice", "cells").mapInArrow(_to_bits(log, top), "row int, slice int, cells binary")
    for r in thin.toLocalIterator():
        mine = np.frombuffer(bytes(r["cells"]), np.uint8)
        bits[r["row"]][r["slice"] * width // 8 : r["slice"] * width // 8 + len(mine)] = mine
    shared = texts.sparkSession.sparkContext.broadcast(bits)
    found = texts.mapInArrow(_survivors(shared, words, log), "lang string, k int, phrase string, f long")
    return written(found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= min_count) | (F.col("k") == 0)), "phrases")


def _to_bits(log: int, top: int):
    width = 1 << min(log, _SLICE)

    def run(batches):
        for batch in batches:
            out = [np.packbits(np.frombuffer(pa.decompress(c.as_buffer(), width * _kind(top)().itemsize, "zstd"), _kind(top)) >= top, bitorder="little").tobytes() for c in batch.column("cells")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("slice"), pa.array(out, pa.binary())], ["row", "slice", "cells"])
    return run


def _part(words: str, at, n) -> F.Column:
    return F.array_join(F.slice(words, at, n), " ")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, k, phrase, a, l, r, score`` of phrases of two words and more, by their lowest-scoring cut; of equal ones the smallest.

    Parts of a phrase occur as often as it does at least, so ``counts`` holds them. Products are decimals of 38 digits.
    """
    c = counts.where("k >= 2").withColumn("w", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    c = c.select("lang", "k", "phrase", F.col("f").alias("a"), "cut", _part("w", 1, F.col("cut")).alias("left"), _part("w", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    part = lambda name, f: counts.where("k > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = c.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("(cast(a as decimal(38,0)) * a * 1000000) div (cast(l as decimal(38,0)) * r)").cast("long")
    best = both.groupBy("lang", "k", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"), F.first("a").alias("a"))
    return best.select("lang", "k", "phrase", "a", "b.l", "b.r", "b.score")


def not_subsumed(candidates: DataFrame, counts: DataFrame, share: int = 50) -> DataFrame:
    """``candidates`` without those inside a longer phrase of ``counts`` that has at least ``share`` hundredths of their occurrences."""
    longer = counts.where("k >= 3").withColumn("w", F.split("phrase", " ")).withColumn("n", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inner = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("n") + 1))).select("lang", _part("w", F.col("at"), F.col("n")).alias("phrase"), "f")
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    got = candidates.join(most, ["lang", "phrase"], "left")
    return got.where(F.coalesce(100 * F.col("within") < share * F.col("a"), F.lit(True))).drop("within")


def best(rows: DataFrame, top: int, by: str = "lang", salts: int = 16) -> DataFrame:
    """The first ``top`` rows of each ``by`` by score, ``a`` (both falling) and phrase, with ``rank``; each of ``salts`` shares gives its own first ones before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    few = salted.withColumn("_k", F.row_number().over(Window.partitionBy(by, "_s").orderBy(*order))).where(F.col("_k") <= top).drop("_k", "_s")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def mine_phrases(docs: DataFrame, words: int = 3, min_count: int = 10, share: int = 50, top: int = 2000, text: str = "text", lang: str = "lang", log: int = 26) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of 2 to ``words`` words of each language.

    Texts (null: empty; A-Z lower-cased) are divided at ``. , ; : ! ?`` and line ends into pieces and those at blanks and tabs into words. A phrase lies
    within a piece and occurs ``a`` times, at least ``min_count``; of its cuts into two parts that occur ``l`` and ``r`` times
    the lowest ``floor(1000000 a a / (l r))`` counts. Phrases inside a longer one of at least ``share`` hundredths of their
    occurrences are left out. ``n`` counts the language's words; a null language is ``und``. Ties: the higher
    ``a``, then the phrase by its bytes. An empty table gives no row; other columns are ignored.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = phrase_counts(texts, words, min_count, log)
    n = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    kept = not_subsumed(scored(counts), counts, share)
    return best(kept, top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
