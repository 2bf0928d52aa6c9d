"""Near-duplicates by DartMinHash signatures, banded joining and exact checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import _words as W
from threadloom.llm._batches import sliced
from threadloom.llm._store import connected_components, written

_U = np.uint64
#: Number of darts in a unit cell, by 16 bits of its hash: Poisson(1).
_POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(14)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)
_ONE = 2.0**-32
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def dart_signatures(elements: np.ndarray, doc: np.ndarray, n_docs: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """``k`` weighted minhashes of each document: array (n_docs, k) of dart names; all ones for a document without weight.

    The plane of (weight, rank) above each element is divided into unit cells. Hashes of element and cell throw a
    Poisson(1) number of darts into a cell, each with a weight, a rank and a coordinate below ``k``. A document
    owns the darts below its weights; per coordinate the one of least rank is its minhash, so two documents agree
    on a coordinate with the probability of their weighted Jaccard similarity. Ranks are thrown only up to
    ``(k ln k + 2 k) / total weight``; where a coordinate stays empty that bound doubles.
    """
    sig = np.full(n_docs * k, _EMPTY)
    if not len(elements):
        return sig.reshape(n_docs, k)
    limit = np.ones(len(elements), np.float64)
    if weights is not None:
        whole = np.maximum(np.ceil(weights).astype(np.int64), 0)
        level = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
        limit = np.minimum(1.0, np.repeat(weights, whole) - level)
        elements = np.repeat(elements, whole) + W.mix(level.astype(_U)) * (level > 0)
        doc = np.repeat(doc, whole)
    total = np.bincount(doc, limit, n_docs)
    todo = np.flatnonzero(total > 0)
    darts = k * math.log(k) + 2 * k
    while len(todo):
        high = np.zeros(n_docs)
        high[todo] = darts / total[todo]
        mine = high[doc] > 0
        el, d, lim = elements[mine], doc[mine], limit[mine]
        slabs = np.ceil(high[d]).astype(np.int64)
        for a, b in _blocks(slabs, 1 << 18):
            n = slabs[a:b]
            slab = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            cell = W.mix(np.repeat(el[a:b], n) + slab.astype(_U) * _U(0xE7037ED1A0B428DB))
            count = _POISSON[(cell >> _U(48)).astype(np.uint16)]
            which = np.repeat(np.arange(len(cell)), count)
            nth = np.arange(1, len(which) + 1) - np.repeat(np.cumsum(count, dtype=np.int64) - count, count)
            dart = W.mix(cell[which] + nth.astype(_U) * _U(0x8EBC6AF09C88C6E3))
            rank = slab[which] + (dart >> _U(32)).astype(np.float64) * _ONE
            owner = np.repeat(np.arange(a, b), n)[which]
            keep = np.flatnonzero(rank < high[d[owner]])
            dart, rank, owner = dart[keep], rank[keep], owner[keep]
            other = W.mix(dart + _U(0x589965CC75374CC3))
            if weights is not None:
                keep = (other >> _U(40)).astype(np.float64) * 2.0**-24 < lim[owner]
                dart, rank, owner, other = dart[keep], rank[keep], owner[keep], other[keep]
            spot = d[owner] * k + ((other & _U(0xFFFFFFFF)) % _U(k)).astype(np.int64)
            # rank in the high bits, the dart's name in the low ones; the name stays unique among equal ranks
            packed = ((rank * 2.0**20).astype(_U) << _U(28)) | (dart & _U(0xFFFFFFF))
            np.minimum.at(sig, spot, packed)
        full = (sig.reshape(n_docs, k)[todo] != _EMPTY).all(axis=1)
        todo, darts = todo[~full], 2 * darts
    return sig.reshape(n_docs, k)


def _blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` units in all; a single larger item stands alone."""
    upto, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for every ``rows`` coordinates; the band's number is part of it."""
    n, k = sig.shape
    bands = k // rows
    x = W.mix(sig[:, : bands * rows].reshape(n, bands, rows) + (np.arange(rows, dtype=_U) + _U(1)) * _U(0xC2B2AE3D27D4EB4F))
    acc = np.zeros((n, bands), _U)
    for j in range(rows):
        acc = W.mix(acc * _U(0x9E3779B97F4A7C15) + x[:, :, j])
    return W.mix(acc + np.arange(bands, dtype=_U) * _U(0xD6E8FEB86659FD93))


def _pieces(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    yield from _blocks(np.array([len(t or "") + 1 for t in texts], np.int64), most)


def _sketcher(k: int, rows: int, size: int):
    def run(batches):
        for batch in sliced(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _pieces(texts):
                words, counts = W.word_hashes(texts[a:b])
                h1, h2 = W.content_hashes(words, counts)
                el, doc = W.cells(*W.shingles(words, counts, size))
                keys = band_keys(dart_signatures(el, doc, b - a, k), rows).astype(np.int64)
                keys = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.ravel())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(h1.astype(np.int64)), pa.array(h2.astype(np.int64)), pa.array(counts), keys], ["id", "h1", "h2", "n_words", "keys"])
    return run


def _verifier(similarity: float, size: int):
    def run(batches):
        for batch in sliced(batches):
            a, b, ta, tb = (batch.column(i) for i in range(4))
            ta, tb = ta.to_pylist(), tb.to_pylist()
            at = {t: i for i, t in enumerate(dict.fromkeys([*ta, *tb]))}
            texts, sets = list(at), []
            for lo, hi in _pieces(texts):
                words, counts = W.word_hashes(texts[lo:hi])
                el, doc = W.cells(*W.shingles(words, counts, size))
                sets += [np.sort(x) for x in np.split(el, np.cumsum(np.bincount(doc, minlength=hi - lo))[:-1])]
            ok = np.zeros(len(ta), bool)
            for i, (x, y) in enumerate(zip(ta, tb, strict=True)):
                x, y = sets[at[x]], sets[at[y]]
                both = np.concatenate([x, y])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                ok[i] = inter >= similarity * (len(both) - inter) - 1e-9
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], ["a", "b"])
    return run


def _active(members: DataFrame, few_pivots: bool) -> DataFrame:
    """``key, id, n, p``: rows of buckets of two or more beside the bucket's size and its pivot, which has no row itself."""
    keyed = members.select("key", "id").distinct()
    order = F.struct((F.xxhash64("id") if few_pivots else F.xxhash64("id", "key")).alias("h"), F.col("id").alias("id"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("low")).where("n > 1").select("key", "n", F.col("low.id").alias("p"))
    return keyed.join(sizes, "key").where("id != p")


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) that ``links`` leave in two classes; other columns stay."""
    label = written(connected_components(links, "a", "b"), "label")
    known = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    both = pairs.join(known("a"), "a", "left").join(known("b"), "b", "left")
    return both.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).drop("_a", "_b")


def pivot_links(members: DataFrame, verify) -> DataFrame:
    """Links between rows (``key``, ``id``) and their buckets' pivots alone: a cheap start for ``link_buckets``, which does the rest."""
    ends = F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")
    return written(verify(written(_active(members, True).select(*ends).distinct(), "pairs")), "links")


def link_buckets(members: DataFrame, verify, payload, within, block: int = 1024, few_pivots: bool = False, known: DataFrame | None = None) -> DataFrame:
    """Links (``a``, ``b``) that join the ids of each class, from rows (``key``, ``id``) that share a bucket.

    First each bucket's rows are compared with one of them, its pivot: ``verify`` turns pairs (``a``, ``b``) into
    those that are links. That settles buckets of two, and those whose rows are then of one class. Rows of the other
    buckets get their data (``payload``: ids to ``id``, ``data``), and ``within`` compares rows of different classes in
    blocks of about ``block`` rows of a bucket; of larger buckets each two blocks meet. It gives only links that
    join two classes, so neither step makes more rows than a bucket has, and every pair of a bucket is either
    compared or already known as one class.

    Where rows of a large group share many buckets, most pairs of row and pivot say what others said before:
    ``few_pivots`` takes the same ids as pivots wherever they occur, compares each row with one of them, and of all other
    pairs only those that are still of two classes. ``known`` are links found before: pairs of one class are not compared again.
    """
    active = written(_active(members, few_pivots), "active")
    ends = F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")
    pairs = active.select(*(("id", "p") if few_pivots else ()), *ends).distinct()
    if known is not None:
        pairs = written(_apart(pairs, known), "pairs")
    if few_pivots:
        one = pairs.groupBy("id").agg(F.min(F.struct(F.xxhash64("p").alias("h"), "p")).alias("low")).select("id", F.col("low.p").alias("p"))
        links = verify(written(one.select(*ends).distinct(), "pairs"))
        links = written(links if known is None else links.unionByName(known), "links")
        rest = _apart(pairs.join(one, ["id", "p"], "left_anti"), links).select("a", "b").distinct()
        links = written(links.unionByName(verify(written(rest, "pairs"))), "links")
    else:
        links = verify(written(pairs, "pairs"))
        links = written(links if known is None else links.unionByName(known), "links")
    classes = connected_components(links, "a", "b")
    open_rows = active.where("n > 2").join(classes, F.col("id") == F.col("node"), "left").select("key", "id", "n", F.coalesce("component", "id").alias("label"))
    mixed = open_rows.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("key")
    rows = written(open_rows.join(mixed, "key"), "mixed")
    if rows.isEmpty():
        return links
    data = payload(rows.select("id").distinct())
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("mine", mine)
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "id", "label", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    full = met.join(data, "id").select("key", "low", "high", "id", "label", "mine", "data")
    more = written(full.groupBy("key", "low", "high").applyInArrow(_by_block(within), "a long, b long"), "links")
    return links.unionByName(more)


def _by_block(within):
    """Compares the rows of a block, or of two blocks with each other, row by row against all later ones."""

    def run(key, table):
        low, high = key[1].as_py(), key[2].as_py()
        ids, label, mine = (table.column(c).to_numpy().copy() for c in ("id", "label", "mine"))
        linked_to = within(key[0].as_py(), table.column("data").to_pylist())
        a, b = [], []
        for i in range(len(ids) - 1):
            apart = label[i + 1 :] != label[i]
            if low != high:
                apart &= mine[i + 1 :] != mine[i]
            js = i + 1 + np.flatnonzero(apart)
            for j in linked_to(i, js) if len(js) else ():
                if label[j] != label[i]:
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _within(similarity: float, bands: int):
    """Exact comparison of whole documents (band keys, then shingle elements) of one bucket.

    Two documents are compared in the bucket of the first band that they share.
    """

    def prepare(key: int, data: list[bytes]):
        keys = np.array([np.frombuffer(d, np.int64, bands) for d in data])
        sets = [np.frombuffer(d, _U, -1, 8 * bands) for d in data]
        sizes = np.array([len(x) for x in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.cumsum(sizes) - sizes
        own = np.zeros(flat.max() + 1, np.int32)
        band = int((keys[0] == key).argmax())

        def linked_to(i: int, js: np.ndarray) -> np.ndarray:
            js = js[(keys[js] == keys[i]).argmax(axis=1) == band]
            js = js[np.minimum(sizes[js], sizes[i]) >= similarity * np.maximum(sizes[js], sizes[i]) - 1e-9]
            if not len(js):
                return js
            spot = flat[first[i] : first[i] + sizes[i]]
            own[spot] = 1
            inter = np.add.reduceat(own[flat], first)[js]
            own[spot] = 0
            return js[inter >= similarity * (sizes[i] + sizes[js] - inter) - 1e-9]

        return linked_to
    return prepare


def _to_cells(size: int):
    def run(batches):
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            keys = batch.column("keys").to_pylist()
            for a, b in _pieces(texts):
                words, counts = W.word_hashes(texts[a:b])
                el, doc = W.cells(*W.shingles(words, counts, size))
                parts = np.split(el, np.cumsum(np.bincount(doc, minlength=b - a))[:-1])
                out = [np.array(k, np.int64).tobytes() + x.tobytes() for k, x in zip(keys[a:b], parts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(out, pa.binary())], ["id", "data"])
    return run


def near_duplicates(
    docs: DataFrame, similarity: float = 0.8, shingle: int = 5, bands: int = 40, rows: int = 7,
    doc_id: str = "doc_id", text: str = "text", broadcast_ids: int = 500_000,
) -> DataFrame:
    """Class of every row of ``docs``: ``doc_id``, ``class_id`` (the class's smallest doc_id), ``n_words``.

    Two documents are linked if the weighted Jaccard similarity of their shingles of five words (lower-cased,
    divided at white space, counted as often as they occur) is at least ``similarity``; classes are the connected
    components of the links. Candidates share one of ``bands`` keys of ``rows`` dart minhashes each, which misses a
    pair at 0.8 with a chance of 1e-4 and a closer one hardly ever; each candidate is then checked on whole texts.
    Texts of fewer than five words count as one shingle. Texts with the same words are one class; so are all texts
    without words (null, empty, blank). Rows with one doc_id are one document; a row without doc_id gets the class
    of its text's other copies, or null. An empty table gives no row; other columns are ignored.
    """
    cols = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    sk = written(cols.mapInArrow(_sketcher(bands * rows, rows, shingle), "id long, h1 long, h2 long, n_words long, keys array<long>"), "sketch")
    same = written(sk.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("n_words").alias("n")), "same")
    reps = sk.join(same.where("n > 0").select("h1", "h2", F.col("rep").alias("id")), ["h1", "h2", "id"]).select("id", "keys")
    members = reps.select(F.explode("keys").alias("key"), "id")

    def texts_of(ids: DataFrame) -> DataFrame:
        ids = written(ids, "ids")
        needed = F.broadcast(ids) if ids.count() <= broadcast_ids else ids  # at most so many numbers of eight bytes
        return cols.join(needed, "id").groupBy("id").agg(F.min("text").alias("text"))

    def verify(pairs: DataFrame) -> DataFrame:
        texts = written(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "texts")
        both = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b")
        return both.select("a", "b", "ta", "tb").mapInArrow(_verifier(similarity, shingle), "a long, b long")

    def payload(ids: DataFrame) -> DataFrame:
        return texts_of(ids).join(reps, "id").select("id", "text", "keys").mapInArrow(_to_cells(shingle), "id long, data binary")

    links = link_buckets(members, verify, payload, _within(similarity, bands))
    again = sk.join(same, ["h1", "h2"]).where("id != rep").groupBy("id").agg(F.min("rep").alias("rep"))
    repeated = sk.groupBy("id").agg(F.count("*").alias("c"), F.min("h1").alias("x"), F.max("h1").alias("y")).where("c > 1 and x != y").select("id")
    links = links.unionByName(again.join(repeated, "id").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    classes = connected_components(links, "a", "b")
    by_text = written(same.join(classes, F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "rep").alias("class_id")), "class")
    return sk.select("id", "h1", "h2", "n_words").join(by_text, ["h1", "h2"]).select(F.col("id").alias(doc_id), "class_id", "n_words")
