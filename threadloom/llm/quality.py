"""Quality by co-training: a text-content and a page-metadata classifier teach each other, then score together."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm._batches import sliced
from threadloom.llm._labels import labelled, platt, sigmoid
from threadloom.llm._store import forget, written

_PAIR_DIMS, _SHAPE_DIMS = 126, 13
_TEXT_DIMS = _PAIR_DIMS + _SHAPE_DIMS
_SIZES = 20
_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_LETTER[128:] = True
#: Byte pairs to text dimensions; letters of either case count alike.
_CLASS = np.arange(256)
_CLASS[65:91] = np.arange(97, 123)
_PAIRS = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % _PAIR_DIMS


def text_view(text: str) -> np.ndarray:
    """What the text says: square roots of hashed byte-pair shares, then kinds of characters, repeated words and lines, and lengths of both."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, low, words, lines = max(1, len(raw)), _CLASS[raw], text.split(), text.split("\n")
    out = np.zeros(_TEXT_DIMS)
    if len(raw) > 1:
        out[:_PAIR_DIMS] = np.sqrt(np.bincount(_PAIRS[low[:-1] * 256 + low[1:]], minlength=_PAIR_DIMS) / (len(raw) - 1))
    kinds = np.bincount(raw, minlength=256)
    letters, digits, space = kinds[_LETTER].sum(), kinds[48:58].sum(), kinds[9:14].sum() + kinds[32]
    distinct = len(set(words)) / max(1, len(words))
    out[_PAIR_DIMS:] = (
        letters / n, digits / n, space / n, 1 - (letters + digits + space) / n, kinds[65:91].sum() / n,
        np.mean([a == b for a, b in zip(words, words[1:], strict=False)]) if len(words) > 1 else 0, distinct, np.sqrt(1 - distinct), float(not words),
        min(4.0, len(raw) / max(1, len(words)) / 20), len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)) / 10, np.log1p(len(words) * (1 - distinct)) / 10,
    )
    return out


#: Columns of the page record: those with one slot for each value, and sizes.
CATEGORIES, SIZES = ("lang", "source"), ("n_chars",)


@dataclass(frozen=True)
class Slots:
    """Places of the metadata view: each known value of each category has one, all others of it share one, and so have ranges of each size."""

    values: tuple[tuple[str, ...], ...]

    @property
    def width(self) -> int:
        return sum(len(v) + 1 for v in self.values) + (_SIZES + 1) * len(SIZES)

    def view(self, categories: list[str | None], sizes: list[int | None]) -> np.ndarray:
        """What the record says, without a look at the text: ones at its values' places and at the ranges of its sizes."""
        out, at = np.zeros(self.width), 0
        for known, value in zip(self.values, categories, strict=True):
            out[at + (known.index(value) if value in known else len(known))] = 1
            at += len(known) + 1
        for size in sizes:
            out[at + (_SIZES if size is None else min(_SIZES - 1, int(np.log2(max(0, size) + 1))))] = 1
            at += _SIZES + 1
        return out


def _views(batch: pa.RecordBatch, slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    column = lambda c: batch.column(c).to_pylist() if c in batch.schema.names else [None] * batch.num_rows
    a = np.array([text_view(t or "") for t in column("text")]).reshape(-1, _TEXT_DIMS)
    records = zip(zip(*map(column, CATEGORIES), strict=True), zip(*map(column, SIZES), strict=True), strict=True)
    b = np.array([slots.view(list(c), list(z)) for c, z in records]).reshape(-1, slots.width)
    return a, b


@dataclass
class CoModel:
    """Weights of both views (last: bias), Platt scale and offset of each, and weights of the joint logit."""

    views: list[np.ndarray]
    scales: list[np.ndarray]
    joint: np.ndarray
    slots: Slots
    constant: float | None = None

    def calibrated(self, xs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        return [s[0] * (x @ w[:-1] + w[-1]) + s[1] for x, w, s in zip(xs, self.views, self.scales, strict=True)]

    def scores(self, xs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(xs[0]), self.constant)
        return sigmoid(np.column_stack(self.calibrated(xs)) @ self.joint[:-1] + self.joint[-1])


def _moments(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums for a least-squares discriminant: class weights, class sums, weighted products; one flat array."""
    x1 = np.column_stack([x, np.ones(len(x))])
    d = x1.shape[1]
    out = np.zeros((2, d, d))
    for c in (0, 1):
        m = (y == c) & (weight > 0)
        out[c] = (x1[m] * weight[m, None]).T @ x1[m]
    return out.ravel()


def _discriminant(moments: np.ndarray, d: int, ridge: float = 1e-4) -> np.ndarray:
    """Weights that fit +1 and -1 with both classes of equal weight."""
    m = moments.reshape(2, d, d)
    n = np.maximum(m[:, -1, -1], 1e-9)
    a = m[0] / n[0] + m[1] / n[1]
    b = m[1][-1] / n[1] - m[0][-1] / n[0]
    return np.linalg.solve(a + ridge * np.eye(d), b)


def _to_views(slots: Slots):
    def run(batches):
        for batch in sliced(batches):
            xs = np.concatenate(_views(batch, slots), axis=1)
            q = np.clip(np.rint(xs * 10_000), 0, 65_535).astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in q], pa.binary())], ["doc_id", "x"])
    return run


def _unpack(column, slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, _TEXT_DIMS + slots.width) / 10_000
    return x[:, :_TEXT_DIMS], x[:, _TEXT_DIMS:]


def _teach(shared, confident: float):
    """Partial moments of both views over rows without a label, by the labels that the other view is sure of."""

    def run(batches):
        model: CoModel = shared.value
        acc, taught = [np.zeros(2 * (d + 1) ** 2) for d in (_TEXT_DIMS, model.slots.width)], 0
        for batch in batches:
            xs = _unpack(batch.column("x"), model.slots)
            for teacher, z in enumerate(model.calibrated(xs)):
                p = sigmoid(z)
                sure = np.maximum(p, 1 - p) >= confident
                pupil = 1 - teacher
                acc[pupil] = acc[pupil] + _moments(xs[pupil][sure], (z[sure] > 0).astype(int), np.ones(int(sure.sum())))
                taught += int(sure.sum())
        if taught:
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in acc], ["m0", "m1"])
    return run


def _add_up(batches):
    acc = None
    for batch in batches:
        for a, b in zip(batch.column("m0").to_pylist(), batch.column("m1").to_pylist(), strict=True):
            got = [np.frombuffer(a), np.frombuffer(b)]
            acc = got if acc is None else [x + y for x, y in zip(acc, got, strict=True)]
    if acc is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in acc], ["m0", "m1"])


def _calibrate(views: list[np.ndarray], xs: tuple[np.ndarray, np.ndarray], y: np.ndarray, slots: Slots) -> CoModel:
    scales = [platt((x @ w[:-1] + w[-1])[:, None], y) for x, w in zip(xs, views, strict=True)]
    model = CoModel(views, scales, np.array([1.0, 1.0, 0.0]), slots)
    model.joint = platt(np.column_stack(model.calibrated(xs)), y)
    return model


def _slots(docs: DataFrame, known: DataFrame, most: int) -> Slots:
    """The ``most`` commonest values of each category among the labelled documents."""
    values = []
    for c in CATEGORIES:
        top = docs.join(known, "doc_id").where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(most).collect() if c in docs.columns else []
        values.append(tuple(r["v"] for r in top))
    return Slots(tuple(values))


def fit(
    docs: DataFrame, labels: DataFrame, rounds: int = 3, confident: float = 0.98, max_labelled: int = 12_000, pseudo_weight: float = 0.5, max_values: int = 64,
    doc_id: str = "doc_id", label: str = "quality",
) -> CoModel:
    """Co-trained model of two separate views: the text alone, and the page's record (language, source, size) alone.

    The labels, at most ``max_labelled`` of them, start both classifiers, least-squares discriminants with classes
    of equal weight; a quarter of them is kept back to calibrate. In each round both classifiers score every
    document without a label in that sample; where one is at least ``confident``, its verdict is a pseudo-label
    for the other. The moments of all such rows, from all documents, are summed on the executors and enter the next fit
    with ``pseudo_weight`` times the labelled rows' weight. The calibrated views are then weighed against each other, so a view
    that tells nothing counts for nothing.

    The ``max_values`` commonest values of a category in the sample have a place of their own. Null and missing columns have theirs. Of
    rows that share a labelled id one is learned from, that of the smallest views. Without labels of both classes the score is constant.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", *CATEGORIES) if c in docs.columns], *[F.col(c).cast("long").alias(c) for c in SIZES if c in docs.columns])
    known = F.broadcast(labelled(labels, label, max_labelled, doc_id))  # at most so many rows
    slots = _slots(docs, known, max_values)
    x = written(docs.mapInArrow(_to_views(slots), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x binary"), "views")
    sample = x.join(known, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("y").alias("y"))
    rows = sorted((str(r["doc_id"]), bytes(r["x"]), r["y"]) for r in sample.toLocalIterator())
    y = np.array([r[2] for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return CoModel([], [], np.zeros(3), slots, constant=1.0 if not len(y) or y.max() == 1 else 0.0)
    xs = _unpack(pa.array([r[1] for r in rows], pa.binary()), slots)
    kept = np.zeros(len(y), bool)
    for c in (0, 1):
        kept[np.flatnonzero(y == c)[::4]] = True
    ones = np.ones(int((~kept).sum()))
    base = [_moments(v[~kept], y[~kept], ones) for v in xs]
    dims = [v.shape[1] + 1 for v in xs]
    check = tuple(v[kept] for v in xs), y[kept], slots
    model = _calibrate([_discriminant(m, d) for m, d in zip(base, dims, strict=True)], *check)
    open_rows = x.join(known, "doc_id", "left_anti").select("x")
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(model)
        partial = open_rows.mapInArrow(_teach(shared, confident), "m0 binary, m1 binary")
        summed = partial.repartition(16).mapInArrow(_add_up, "m0 binary, m1 binary")
        got = [np.zeros_like(m) for m in base]
        for r in summed.toLocalIterator():  # sixteen rows at most
            got = [g + np.frombuffer(bytes(r[c])) for g, c in zip(got, ("m0", "m1"), strict=True)]
        views = []
        for b, g, d in zip(base, got, dims, strict=True):
            b, g = b.reshape(2, d, d), g.reshape(2, d, d)
            mass = g[:, -1, -1] / np.maximum(b[:, -1, -1], 1e-9)
            views.append(_discriminant((b + g * (pseudo_weight / np.maximum(mass, pseudo_weight))[:, None, None]).ravel(), d))
        model = _calibrate(views, *check)
    forget(x)
    return model


def score_documents(docs: DataFrame, model: CoModel) -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1, higher: good likelier) and ``accepted`` (score of 0.5 or more).

    Null text counts as empty, null and missing metadata as unknown; repeated rows and other columns stay; columns named like
    the new ones are replaced; an empty table gives no row.
    """
    docs = docs.drop("quality_score", "accepted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches):
            s = np.clip(shared.value.scores(_views(batch, shared.value.slots)), 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array(s >= 0.5)], [*batch.schema.names, "quality_score", "accepted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return docs.mapInArrow(run, schema)
