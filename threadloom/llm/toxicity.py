"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm import _words as W
from threadloom.llm._batches import sliced
from threadloom.llm._labels import labelled, platt, sigmoid
from threadloom.llm._store import written

_U = np.uint64
_BITS, _DIM, _PREFIXES = 17, 4, (4, 5)
_TABLES = 2 + len(_PREFIXES)
_WIDTHS, _FILTERS = (1, 2, 3), 8
_PAD = max(_WIDTHS) - 1
#: Frequent short words of each language, by which a text's language is guessed.
MARKS = {
    "de": ("der", "die", "und", "das", "ist", "den", "von", "mit", "nicht", "ein", "eine", "zu", "sich", "auf"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "was", "for", "on", "are", "with", "by", "this"),
    "es": ("el", "los", "que", "y", "las", "del", "una", "por", "con", "para", "se", "su", "al", "como"),
    "fr": ("le", "les", "et", "des", "est", "pour", "qui", "dans", "du", "sur", "au", "pas", "une", "plus"),
}
LANGS = (*MARKS, "")
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """True for ids whose crc32 (as text) leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes (words, columns: word and prefixes) of all texts and the number of words of each."""
    words, counts, *pre = W.word_hashes(texts, space=W.PUNCTUATED, prefixes=_PREFIXES)
    return np.column_stack([(x >> _U(32)).astype(np.uint32) for x in (words, *pre)]).reshape(-1, 1 + len(_PREFIXES)), counts


def buckets(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding tables for each word, texts parted by padding (row 0 of each table); first row of each text."""
    n = len(hashes)
    first = np.cumsum(counts + _PAD) - (counts + _PAD)
    at = np.arange(n) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    out = np.zeros((int(counts.sum()) + _PAD * len(counts), _TABLES), np.int32)
    most = np.uint32((1 << _BITS) - 1)
    w = hashes[:, 0]
    out[at, 0] = w % most + 1
    out[at, 1] = (w * np.uint32(0x9E3779B1) ^ w >> np.uint32(15)) % most + 1
    for k in range(len(_PREFIXES)):
        out[at, 2 + k] = hashes[:, 1 + k] % most + 1
    return out, first


_MARK_HASHES: dict[str, np.ndarray] = {}


def guess_language(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Index into LANGS for each text: the language with most of its frequent words, the last for none."""
    if not _MARK_HASHES:
        for k, v in MARKS.items():
            _MARK_HASHES[k] = np.sort(features(list(v))[0][:, 0])
    upto = np.concatenate([[0], np.cumsum(counts)])
    score = np.zeros((len(counts), len(LANGS)))
    for k, marks in enumerate(_MARK_HASHES.values()):
        hit = np.concatenate([[0], np.cumsum(np.isin(hashes[:, 0], marks))])
        score[:, k] = hit[upto[1:]] - hit[upto[:-1]]
    score[:, -1] = 0.5
    return score.argmax(axis=1)


@dataclass
class ConvNet:
    """Embedding tables, filters of several widths with max pooling, one output; then a scale and thresholds by language."""

    tables: list[np.ndarray] = field(default_factory=list)
    filters: list[np.ndarray] = field(default_factory=list)  # (width * inputs, filters)
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    scale: float = 1.0
    thresholds: np.ndarray | None = None
    constant: float | None = None

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([t[rows[:, k]] for k, t in enumerate(self.tables)], axis=1)

    def maps(self, x: np.ndarray) -> np.ndarray:
        n, d = x.shape
        cols = []
        for w, f in zip(_WIDTHS, self.filters, strict=True):
            y = x @ f[:d]
            for j in range(1, w):
                y[: n - j] += x[j:] @ f[j * d : (j + 1) * d]
            cols.append(y)
        return np.concatenate(cols, axis=1)

    def pooled(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum.reduceat(self.maps(x), first, axis=0) + self.bias, 0)

    def logits(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        rows, first = buckets(hashes, counts)
        return self.pooled(self.embed(rows), first) @ self.out[:-1] + self.out[-1]

    def scores(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Calibrated so that each language's threshold becomes THRESHOLD."""
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        z = self.logits(hashes, counts) - self.thresholds[guess_language(hashes, counts)]
        return sigmoid(self.scale * z + np.log(THRESHOLD / (1 - THRESHOLD)))


def train(hashes: list[np.ndarray], y: np.ndarray, batch: int = 64, rate: float = 0.02, seed: int = 7) -> ConvNet:
    """Fits on three quarters of the texts and sets scale and thresholds on the rest.

    Embeddings start with the smoothed log-odds of a bucket's document frequencies, so a filter sees telling words
    from the first step; Adam then moves filters and output, and plain steps the embeddings under the maxima. Few
    texts are gone through up to twelve times, many three times.
    """
    if not len(y) or y.min() == y.max():
        return ConvNet(constant=0.0 if not len(y) or y.max() == 0 else 1.0)
    rng = np.random.default_rng(seed)
    perm = rng.permutation(len(y))
    hold = np.zeros(len(y), bool)
    for label in (0, 1):
        mine = perm[y[perm] == label]
        hold[mine[: len(mine) // 4]] = True
    fit = np.flatnonzero(~hold)
    counts = np.array([len(h) for h in hashes])
    net = ConvNet()
    df = np.zeros((2, _TABLES, 1 << _BITS), np.float32)
    for i in fit:
        rows, _ = buckets(hashes[i], counts[i : i + 1])
        for k in range(_TABLES):
            df[y[i], k, np.unique(rows[:, k])] += 1
    n1, n0 = max(1, int(y[fit].sum())), max(1, int((y[fit] == 0).sum()))
    odds = np.log((df[1] + 0.2) / (n1 + 0.4)) - np.log((df[0] + 0.2 * n0 / n1) / (n0 + 0.4 * n0 / n1))
    odds *= np.minimum(1, (df[1] + df[0] * n1 / n0) / 3)  # a bucket of few texts says little
    for k in range(_TABLES):
        t = rng.normal(0, 0.05, (1 << _BITS, _DIM)).astype(np.float32)
        t[:, 0] = np.clip(odds[k], -4, 4) / 4
        t[0] = 0
        net.tables.append(t)
    d = _TABLES * _DIM
    net.filters = [rng.normal(0, 0.1, (w * d, _FILTERS)).astype(np.float32) for w in _WIDTHS]
    for f in net.filters:
        f[0:d:_DIM] += 0.25
    n_f = _FILTERS * len(_WIDTHS)
    net.bias = np.full(n_f, -0.2, np.float32)
    net.out = np.concatenate([np.full(n_f, 0.5), [-1.0]]).astype(np.float32)
    params = [*net.filters, net.bias, net.out]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = np.sqrt(np.where(y == 1, 0.5 * len(fit) / n1, 0.5 * len(fit) / n0))
    for epoch in range(int(np.clip(15_000 // len(y), 3, 12))):
        lr = rate * 0.6**epoch
        turn = rng.permutation(fit)
        for at in range(0, len(fit), batch):
            ids = turn[at : at + batch]
            rows, first = buckets(np.concatenate([hashes[i] for i in ids]), counts[ids])
            x = net.embed(rows)
            maps = net.maps(x)
            ends = np.append(first[1:], len(x))
            top = np.stack([a + maps[a:b].argmax(axis=0) for a, b in zip(first, ends, strict=True)])
            h = np.maximum(np.take_along_axis(maps, top, 0) + net.bias, 0)
            g = (sigmoid(h @ net.out[:-1] + net.out[-1]) - y[ids]) * weight[ids] / len(ids)
            grads = [np.zeros_like(f) for f in net.filters]
            gh = (g[:, None] * net.out[:-1]) * (h > 0)
            padded = np.concatenate([x, np.zeros((_PAD, d), np.float32)])
            for k, w in enumerate(_WIDTHS):
                cols = slice(k * _FILTERS, (k + 1) * _FILTERS)
                for j in range(w):
                    pos = top[:, cols] + j
                    part = slice(j * d, (j + 1) * d)
                    grads[k][part] = np.einsum("bf,bfd->df", gh[:, cols], padded[pos])
                    flat = np.minimum(pos.ravel(), len(rows) - 1)
                    gx = (gh[:, cols, None] * net.filters[k][part].T[None]).reshape(-1, d)
                    for t in range(_TABLES):
                        np.add.at(net.tables[t], rows[flat, t], -lr * 2 * gx[:, t * _DIM : (t + 1) * _DIM])
            for t in net.tables:
                t[0] = 0
            grads += [gh.sum(axis=0), np.append(h.T @ g, g.sum())]
            step += 1
            for k, (p, gr) in enumerate(zip(params, grads, strict=True)):
                gr = gr + 1e-4 * p
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.99 * v[k] + 0.01 * gr * gr
                p -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(p.dtype)
    check = np.flatnonzero(hold) if len(np.unique(y[hold])) == 2 else np.arange(len(y))
    z, lang = [], []
    for at in range(0, len(check), 256):
        ids = check[at : at + 256]
        hs = np.concatenate([hashes[i] for i in ids])
        z.append(net.logits(hs, counts[ids]))
        lang.append(guess_language(hs, counts[ids]))
    z, lang, yc = np.concatenate(z), np.concatenate(lang), y[check]
    net.scale = float(np.clip(platt(z[:, None], yc)[0], 0.2, 5))
    common = _threshold(z, yc)
    net.thresholds = np.full(len(LANGS), common)
    for k in range(len(LANGS)):
        mine = lang == k
        if yc[mine].sum() >= 15 and (yc[mine] == 0).sum() >= 15:
            net.thresholds[k] = _threshold(z[mine], yc[mine])
    return net


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """Logit of best F1, in the middle of the gap it lies in."""
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + y.sum())
    best = int(f1.argmax())
    low = z[order][best]
    return float((low + z[order][best + 1]) / 2 if best + 1 < len(z) else low - 0.5)


def _to_features(batches):
    for batch in sliced(batches):
        texts = batch.column("text").to_pylist()
        for i, t in enumerate(texts):
            h, _ = features([t])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), batch.column("y").slice(i, 1), pa.array([h.tobytes()], pa.binary())], ["doc_id", "y", "hashes"])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 6_000, max_chars: int = 64 << 20, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ConvNet:
    """The network fitted on labelled documents, none of them held out: at most ``max_labelled`` and ``max_chars`` characters of them in all.

    Both bounds keep documents of the smallest id hashes, whole. Both tables name their ids ``doc_id``. Of rows that share a labelled id
    one is learned from, that of the smallest text. Null ids and labels are left out, null text counts as empty; without labels of
    both classes, and for an empty table, no document is predicted.
    """
    rows = F.broadcast(labelled(labels, label, max_labelled, doc_id, usable=lambda c: ~held_out(c)))  # at most so many rows
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(rows, "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y"))
    sample = written(texts, "sample")  # both jobs below read the same few texts
    sizes = sample.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.char_length("text").alias("n")).collect()  # at most max_labelled rows
    sizes.sort(key=lambda r: (r["h"], str(r["doc_id"])))
    upto = np.cumsum([r["n"] for r in sizes])
    if len(sizes) and upto[-1] > max_chars:
        few = [(r["doc_id"],) for r, n in zip(sizes, upto, strict=True) if n <= max_chars]
        ids = docs.sparkSession.createDataFrame(few, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}")
        sample = sample.join(F.broadcast(ids), "doc_id")
    id_type = sample.schema["doc_id"].dataType.simpleString()
    got = sample.select("doc_id", "y", "text").mapInArrow(_to_features, f"doc_id {id_type}, y int, hashes binary")
    known = sorted(((r["doc_id"], bytes(r["hashes"]), r["y"]) for r in got.toLocalIterator()), key=lambda r: (str(r[0]), r[1]))
    hashes = [np.frombuffer(h, np.uint32).reshape(-1, 1 + len(_PREFIXES)) for _, h, _ in known]
    return train(hashes, np.array([y for _, _, y in known], np.int64))


def score_documents(docs: DataFrame, net: ConvNet, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least THRESHOLD).

    Scores depend on whole texts alone. Null and empty texts are scored as texts without words; repeated rows and
    other columns stay; columns named like the new ones are replaced; an empty table gives no row.
    """
    docs = docs.drop("score", "predicted")
    shared, where = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index(text)

    def run(batches):
        model = shared.value
        for batch in sliced(batches):
            texts, at = batch.column(where).to_pylist(), 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < 1 << 20):
                    chars += len(texts[to] or "")
                    to += 1
                s = np.clip(model.scores(*features(texts[at:to])).astype(np.float64), 0, 1)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*part.schema.names, "score", "predicted"])
                at = to

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)
